"""Jobs that turn text tables into training data. Nothing else in the library imports this package.

The text operators default to the fields of the alert table: ``alert_id`` (key), ``alert_type`` (its text,
which the raw layouts also call ALERT_TEXT) and ``layout_name`` (its source).
"""
