"""Matrices from dense rows, triplets, compressed or list-of-lists contents, constants."""

from .leaves import (
    compress_triplets,
    constant,
    from_compressed,
    from_compressed_tables,
    from_coo,
    from_custom,
    from_flat,
    from_fragmented,
    from_rows,
    from_triplets,
    sorted_triplets,
)

from .custom import from_blocks
from .packed import open_packed, packed_tiles, write_packed
from .store import count_stored, entries_between, open_compressed, open_tiles, stored_contents, tile_stats, write_compressed, write_tiles

__all__ = ["count_stored", "entries_between", "from_blocks", "open_compressed", "open_packed", "open_tiles", "packed_tiles", "sorted_triplets", "stored_contents", "tile_stats", "write_compressed", "write_packed", "write_tiles", "compress_triplets", "constant", "from_compressed", "from_compressed_tables", "from_coo", "from_custom", "from_flat", "from_fragmented", "from_rows", "from_triplets"]
