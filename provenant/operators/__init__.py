from . import behaviour, cleaning, exchange, forest, funding, labels, master, metrics, walks  # noqa: F401
