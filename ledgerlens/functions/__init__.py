"""Column expressions (JVM-side, codegen-friendly) used across the library."""

from ledgerlens.functions.text import (  # noqa: F401
    missing_to_null, to_number, to_factor_number, clean_category,
)
from ledgerlens.functions.dates import (  # noqa: F401
    parse_ledger_date, parse_factor_date, date_from_year_mo, month_key,
    calendar_features,
)
