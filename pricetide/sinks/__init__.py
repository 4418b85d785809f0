from pricetide.sinks.files import (  # noqa: F401
    append_silver,
    export_csv,
    overwrite_dates,
    overwrite_parquet,
    read_csv,
    write_report,
)
from pricetide.sinks.serving import (  # noqa: F401
    GROWING,
    SERVING_NAMES,
    TABLES,
    jdbc_writer,
    load_new_rows,
    load_tables,
    require_loaded,
    rename_columns,
    serving_preview,
)
