from pricetide.sources.landing import (  # noqa: F401
    landing_files,
    normalize_payload,
    read_landing,
    read_payload,
    stream_landing,
)
from pricetide.sources.tables import read_table, read_table_or_none  # noqa: F401
