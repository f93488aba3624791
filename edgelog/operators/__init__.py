"""DataFrame -> DataFrame operators (layout, view, metrics, alarms,
classification, notifications, log stitching)."""
