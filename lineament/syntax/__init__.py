"""Light parsers for four languages: functions, blocks, branches, symbols."""
