from .oracles import oracle_sql  # noqa: F401
from .queries import queries  # noqa: F401
