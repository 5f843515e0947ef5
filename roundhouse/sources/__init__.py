from .tables import TableSource  # noqa: F401
from .files import read_csv_table, read_csv_quarantined, payload_fields, payload_variant  # noqa: F401
from .sinks import write_csv, write_report, create_if_absent, report_row_counts  # noqa: F401
