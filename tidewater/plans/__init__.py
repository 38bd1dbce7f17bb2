"""Plan-level building blocks: order statistics, framed windows, calendars, staging."""
