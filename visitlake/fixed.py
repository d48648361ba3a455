"""Values that must equal the reference service's for the same results."""

# Fixed values (kept in the reference's order of appearance):
PREVIEW_ROWS = 50                       # console preview row limit
REPORT_ZONE = "Asia/Jerusalem"          # zone of the conversion reports
TRAILING_MONTHS = 12                    # "last year" of the visitor report
SESSION_GAP_SECONDS = 1800              # 30 minutes of inactivity ends a session
UNKNOWN_CAMPAIGN = "Unknown"            # campaign name when none is known
CAMPAIGN_NAME_FIELD = "Campaign name"   # outward name of the campaign column
CAMPAIGN_NAME_SEPARATOR = " - "         # "type - description" campaign names
SECOND_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"  # date_time text of conversions
PARENT_PREFIX = "parent_"               # flattened path fields
