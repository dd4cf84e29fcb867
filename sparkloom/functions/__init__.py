from sparkloom.functions.scalar import (
    add_days, add_months, case_when, days_between, extract, int_div, lenient_cast, like, simple_case, substring,
)

__all__ = ["add_days", "add_months", "case_when", "days_between", "extract", "int_div", "lenient_cast", "like", "simple_case", "substring"]
