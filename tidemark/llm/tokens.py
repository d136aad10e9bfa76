"""Token counts of whole texts with a ``tokenizers`` vocabulary.

Arrow functions return lengths only. Each task regroups its rows into batches of about equal
bytes (of UTF-8, as Arrow holds them); texts longer than a batch are split at white space and
their parts counted like rows of their own. White space is a safe boundary for a vocabulary
that drops it between words: no token and no added token spans it, and no normaliser step looks
across it. Any other vocabulary is refused. Inside a batch each different word is encoded once,
and known words are kept in a table of bounded bytes.

Defined results: a null text is empty (0 bytes, 0 tokens); strings of special tokens inside a
text are handled as the library does by default; repeated rows are counted each.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import SPACES, per_worker

#: Bytes of text in a batch, and bytes of the words whose counts a worker keeps.
BATCH_BYTES = 8 << 20
KNOWN_BYTES = 192 << 20
#: What a word in the table takes beside its own bytes.
_ENTRY = 128


def split_safely(text: str | bytes, limit: int) -> Iterator[str | bytes]:
    """Parts of at most ``limit`` characters, or bytes of UTF-8, cut at white space; a longer word
    stays whole."""
    start, n = 0, len(text)
    spaces = list(SPACES) if isinstance(text, str) else [c.encode() for c in SPACES]
    while n - start > limit:
        cut = max(text.rfind(c, start + 1, start + limit) for c in spaces)
        if cut < 0:
            after = [p for p in (text.find(c, start + limit) for c in spaces) if p >= 0]
            if not after:
                break
            cut = min(after)
        yield text[start:cut]
        start = cut
    yield text[start:]


def balanced(texts: Iterable[bytes | None], limit: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Batches (row numbers, parts) of about ``limit`` bytes: a batch ends with the part that
    reaches it, so it is below two limits unless a word is longer than one."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for part in split_safely(t or b"", limit):
            rows.append(i)
            parts.append(part)
            size += len(part)
            if size >= limit:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


class WordCounter:
    """Token counts of texts as sums over their words; ``lengths`` encodes a list of words.

    The table of known words never holds more than ``known`` bytes: it is emptied where new ones
    would go beyond that, and a word that takes over a thousandth of it is counted but not kept.
    """

    def __init__(self, lengths: Callable[[list[str]], list[int]], known: int = KNOWN_BYTES):
        self.lengths, self.known, self.table, self.held = lengths, known, {}, 0

    def of_words(self, words: list[str]) -> np.ndarray:
        get = self.table.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            found = self.lengths(fresh)
            out[new] = found
            for w, n in zip(fresh, found):
                self._keep(w, n)
        return out

    def _keep(self, word: str, n: int) -> None:
        size = sys.getsizeof(word) + _ENTRY
        if 1000 * size > self.known:
            return
        if self.held + size > self.known:
            self.table, self.held = {}, 0
        self.table[word] = n
        self.held += size

    def counts(self, parts: list[bytes]) -> np.ndarray:
        """Tokens of each part."""
        split = pc.ascii_split_whitespace(pa.array(parts, pa.large_binary()).cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        per_word = self.of_words(coded.dictionary.to_pylist())
        sums = np.concatenate(([0], np.cumsum(per_word[coded.indices.to_numpy()])))
        at = split.offsets.to_numpy()
        return sums[at[1:]] - sums[at[:-1]]


def refuse_spaces(tok) -> None:
    """Raises unless the vocabulary of the library's ``tok`` drops each white space character
    between words: then two words have the tokens that each has alone."""
    words = ["ab", "Ab1", "1", "'s", ".", "é", "漢", "\u0301"]
    alone = {w: tok.encode(w, add_special_tokens=False).ids for w in words}
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    if any(c in t for t in added for c in SPACES):
        raise ValueError("an added token holds white space")
    for space in SPACES + "  ":
        for a in words:
            for b in words:
                if tok.encode(f"{a}{space}{b}", add_special_tokens=False).ids != alone[a] + alone[b]:
                    raise ValueError("the vocabulary doesn't drop white space between words: texts can't be split there")


def _library_lengths(path: str):
    """Lengths by the library, as it counts by default, without added begin or end tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    refuse_spaces(tok)

    def lengths(words):
        out = []
        for i in range(0, len(words), 4096):
            out += [len(e) for e in tok.encode_batch_fast(words[i:i + 4096], add_special_tokens=False)]
        return out
    return lengths


def _count(path, batch_bytes, known):
    def run(batches):
        counter = per_worker(f"count {path} {known}", lambda: WordCounter(_library_lengths(path), known))
        for b in batches:
            texts = b.column(1)
            total = np.zeros(b.num_rows, np.int64)
            for rows, parts in balanced((t.as_py() for t in texts.cast(pa.large_binary())), batch_bytes):
                np.add.at(total, rows, counter.counts(parts))
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(total)],
                                             names=["id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, key: str, text: str, path: str, batch_bytes: int = BATCH_BYTES,
                 known: int = KNOWN_BYTES) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` per row, for the vocabulary file at ``path``.

    For vocabularies that drop white space between words; for any other the job fails, on its
    first rows, rather than counting wrongly. ``path`` must be readable by the executors.
    """
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        _count(path, batch_bytes, known),
        f"id {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
