"""The sparse incidence matrix of documents by n-grams, in blocks of columns.

An entry is (column, document). A pack of documents gives its entries of one block of columns as one row of plain
bytes, so that the matrix crosses the shuffle at 9 to 12 bytes an entry. A block is a range of column hashes, sized by
the number of all entries: a task holds one block at a time, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Entries of one block, and of one pack over all blocks, about.
BLOCK_ENTRIES, PACK_ENTRIES = 1 << 20, 1 << 19
#: block, and of that block's entries, document by document: column hashes; places; and for each document: id and number of entries. least: the least of the ids, which the others are counted from.
SCHEMA = "block int, least long, columns binary, places binary, ids binary, counts binary"


def block_count(entries: int) -> int:
    return max(1, -(-entries // BLOCK_ENTRIES))


def packed(parts: Iterable[tuple[np.ndarray, ...]], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA of parts (column hashes, id of each entry's document, place of each or nothing, salt of each or nothing).
    A column with salts is in a block of each salt, and blocks of salt n are numbered from n * blocks on."""
    held: list[tuple[np.ndarray, ...]] = []
    entries = 0
    for part in parts:
        held.append(part)
        entries += len(part[0])
        if entries >= PACK_ENTRIES:
            yield _pack(held, blocks)
            held, entries = [], 0
    if entries:
        yield _pack(held, blocks)


def _narrow(x: np.ndarray) -> bytes:
    """The values of x (none negative) in the least of 1, 2, 4 or 8 bytes each, after that number."""
    most = int(x.max())
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(x: pa.Buffer) -> np.ndarray:
    x = memoryview(x)
    return np.frombuffer(x[1:], f"u{x[0]}").astype(np.int64)


def _pack(parts: list[tuple[np.ndarray, ...]], blocks: int) -> pa.RecordBatch:
    column, ids, place, *salt = (np.concatenate(x) for x in zip(*parts, strict=True))
    block = (((column >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int32)
    block = block + (salt[0] * blocks).astype(np.int32) if salt else block
    order = np.lexsort((ids, block))
    column, ids, block = column[order], ids[order], block[order]
    begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    out: dict[str, list] = {c: [] for c in ("least", "columns", "places", "ids", "counts")}
    place = place[order].astype(np.int64) if len(place) else place
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(block)], strict=True):
        first, count = runs(ids[a:b])
        own = ids[a:b][first]
        out["least"].append(int(own[0]))
        out["columns"].append(column[a:b].tobytes())
        out["places"].append(_narrow(place[a:b]) if len(place) else b"")
        out["ids"].append(_narrow((own.view(np.uint64) - own[:1].view(np.uint64))))
        out["counts"].append(_narrow(count))
    kinds = {"least": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(block[begins]), *[pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()]], ["block", *out])


def unpacked(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """column, id and place (or nothing) of all entries of one block, sorted by column, id and place."""
    columns, ids, places = [], [], []
    for r in zip(*(block.column(c) for c in ("least", "columns", "places", "ids", "counts")), strict=True):
        least, (own, place, docs, counts) = r[0].as_py(), (x.as_buffer() for x in r[1:])
        columns.append(np.frombuffer(own, np.uint64))
        ids.append(np.repeat(_wide(docs) + least, _wide(counts)))
        places.append(_wide(place) if place.size else np.zeros(0, np.int64))
    column, doc, place = (np.concatenate(x) for x in (columns, ids, places))
    order = np.lexsort((place, doc, column) if len(place) else (doc, column))
    return column[order], doc[order], place[order] if len(place) else place


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and how long it is."""
    begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return begins, np.diff(np.append(begins, len(x)))
