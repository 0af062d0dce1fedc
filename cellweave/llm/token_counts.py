"""Token counts by field and section: whole documents are encoded once and token spans attributed to sections.

A document is its fields (text columns) with a newline between them. A section is a line of a field with its newline.
Tokens are mapped to spans of characters (a token that holds part of a character's bytes covers that character) and
joined with the sections' spans. A token that lies in one section counts there. A token that crosses a border counts
for the section that holds most of its characters; of equals, for the first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a vocabulary of ranks is installed (a default; the path is a parameter), and the pattern that parts text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[int, tuple] = {}


def encoder(ranks: dict[bytes, int]):
    """The encoding of these ranks and the bytes of each token, made once a process."""
    key = id(ranks)
    if key not in _encoders:
        import tiktoken

        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size, ranks
    return _encoders[key][:2]


def token_chars(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last; ends: where tokens end in the UTF-8 bytes data."""
    nth = np.cumsum((data & 0xC0) != 0x80)  # characters that begin up to each byte
    starts = np.concatenate([[0], ends[:-1]])
    return nth[starts] - 1, nth[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, int]:
    """Section of each token and how many tokens cross a border.

    starts, ends: the tokens' spans, both rising; borders: where sections end, the last at the text's end. The join
    of the two sets of intervals is a search in each direction, as both are sorted."""
    first = np.searchsorted(borders, starts, "right")
    last = np.searchsorted(borders, ends, "left")
    section = first.copy()
    crossing = np.flatnonzero(last > first)
    for i in crossing.tolist():
        edges = np.concatenate([[starts[i]], borders[first[i] : last[i]], [ends[i]]])
        section[i] = first[i] + int(np.argmax(np.diff(edges)))
    return section, len(crossing)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(key, n_tokens, n_sections, n_crossing, most, section_tokens, field_tokens) of each whole document.

    section_tokens: the tokens of each section, in order; their sum is n_tokens; most is the largest. field_tokens: the
    tokens of each field; the newline after a field belongs to it. A null field is empty. A document without
    characters has no tokens and no sections. Rows repeat as they are, null keys pass, other columns are ignored, an
    empty table gives no rows. The vocabulary is read by the driver and sent to tasks: one file of fixed size."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    names = ["key", "n_tokens", "n_sections", "n_crossing", "most", "section_tokens", "field_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = encoder(ranks.value)
        for b in batches:
            rows = []
            for parts in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                x = "\n".join(p or "" for p in parts)
                if not x:
                    rows.append((0, 0, 0, 0, [], [0] * len(parts)))
                    continue
                data = np.frombuffer(x.encode(), np.uint8)
                starts, ends = token_chars(data, np.cumsum(size[encoding.encode_to_numpy(x, disallowed_special=())]))
                chars = data[(data & 0xC0) != 0x80]  # a newline is the only character that begins with its byte
                borders = np.flatnonzero(chars == 10) + 1
                if not len(borders) or borders[-1] < len(chars):
                    borders = np.append(borders, len(chars))
                section, crossing = attribute(starts, ends, borders)
                per = np.bincount(section, minlength=len(borders))
                field_ends = np.cumsum([len(p or "") + 1 for p in parts])
                of = np.minimum(np.searchsorted(field_ends, borders, "left"), len(parts) - 1)
                by_field = np.bincount(of, weights=per, minlength=len(parts)).astype(np.int64)
                rows.append((len(ends), len(borders), crossing, int(per.max()), per.tolist(), by_field.tolist()))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    kind = docs.schema[key].dataType.simpleString()
    texts = [F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields)]
    out = docs.select(F.col(key).alias("key"), *texts).mapInArrow(run, f"key {kind}, n_tokens long, n_sections long, n_crossing long, most long, section_tokens array<long>, field_tokens array<long>")
    return out.withColumnRenamed("key", key)
