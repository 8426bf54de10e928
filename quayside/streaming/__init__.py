from .scoring import score_stream, running_confusion, order_line_stream

__all__ = ["score_stream", "running_confusion", "order_line_stream"]
