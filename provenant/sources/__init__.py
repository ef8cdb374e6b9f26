from .readers import (  # noqa: F401
    InvalidExtractError,
    pointer_files,
    key_sets,
    literal_set,
    read_csv_directory,
    read_csv_file,
    read_line_set,
    read_table,
    tables,
)
from .sinks import offset_chunk, rank_chunk, replace_table, write_csv, write_lines  # noqa: F401
