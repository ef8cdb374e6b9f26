from .first_funding import event_window_counts, first_funding_stream, merge_first  # noqa: F401
