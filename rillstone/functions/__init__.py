"""Languages inside rules, compiled to columns: dissection and grok patterns, arithmetic, time formats, domains, addresses."""
