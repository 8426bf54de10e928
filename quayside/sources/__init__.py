from .tables import TABLE_COLUMNS, read_table, order_lines, ORDER_LINE_NUMERIC, ORDER_LINE_CATEGORICAL

__all__ = ["TABLE_COLUMNS", "read_table", "order_lines",
           "ORDER_LINE_NUMERIC", "ORDER_LINE_CATEGORICAL"]
