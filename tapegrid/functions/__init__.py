from tapegrid.functions.columns import (
    bar_position,
    bar_time,
    both,
    month_of,
    ratio,
    stack_columns,
    uniform,
)

__all__ = ["bar_position", "bar_time", "both", "month_of", "ratio", "stack_columns", "uniform"]
