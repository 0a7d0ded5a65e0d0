"""Work on whole Arrow columns of texts inside tasks: splitting into words and telling words apart is done by Arrow, once for each different word by Python."""

from __future__ import annotations

import ctypes
import gc
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at once; a longer text is taken alone.
STRETCH = 4_000_000
#: ASCII characters that are cut off from both ends of a word before its letters are looked up.
EDGES = ".,;:!?|#$%&*()[]{}<>=+/\\-\"'`~@^_0123456789"
#: Letters (as a class of a regular expression, without A-Z) that stay letters, one for one, when composed and lower-cased.
PLAIN = "a-z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c)


def release_memory() -> None:
    """Give back what is free: workers and drivers live on for other stages, which need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def stretches(sizes: np.ndarray, most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to at most ``most``; a larger row is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes):
        yield start, len(sizes)


def text_stretches(texts: pa.Array, most: int = STRETCH) -> Iterator[tuple[int, int, pa.Array]]:
    """First row, last row and texts (null: empty) of each stretch of a column."""
    texts = pc.fill_null(texts, "")
    for lo, hi in stretches(np.asarray(pc.binary_length(texts)), most):
        yield lo, hi, texts.slice(lo, hi - lo)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: where each text's words start (and the last end), each word's number, and the distinct words.

    White space at the ends of a text makes empty words.
    """
    words = pc.ascii_split_whitespace(texts)
    first = np.asarray(words.offsets).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    return first - first[0], np.asarray(flat.indices), flat.dictionary


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + n) one after another."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
