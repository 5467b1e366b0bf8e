"""Reading tables and event logs, binding logical columns, writing results."""
