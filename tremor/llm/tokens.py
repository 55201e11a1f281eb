"""Token counts with the whole-token shortcut.

A byte-level BPE cuts a text into pre-tokens and merges within each.  Offline (on the
driver, once) every string of the vocabulary is encoded alone; those that come out as
one token are proven *whole*: a pre-token equal to one of them is that token, without
merging.  Workers match pre-tokens against them directly and merge only the rest, whose
results are remembered up to a fixed number of entries.

A text that holds a special token's string, or a character whose class could differ
between Unicode versions, is given to the library as a whole, so the shortcut never
decides a case it was not proven for.  Null counts as the empty text, which has no
tokens; repeated rows are counted each; other columns are ignored.
"""

import json
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import worker_store

#: Pre-tokens of byte-level BPE, as the public tokenizers define them (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same, as the ranked merger's engine reads it (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes have been the same in all Unicode versions since 3.0.
SETTLED = r"\x09-\x0d\x20-\x7e\xa0-ȳЀ-҆҈-ӿ‐-‧‰-⁆€"
REMEMBERED = 400_000


def tokenizer_at(path):
    """The library's tokenizer, one per worker; single-threaded."""
    store = worker_store().setdefault("tokenizers", {})
    if path not in store:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        store[path] = Tokenizer.from_file(path)
    return store[path]


def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings proven to encode alone as one token, with its id (at most the vocabulary)."""
    tokenizer = tokenizer_at(path)
    shown = byte_characters()
    strings = []
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    for token in tokenizer.get_vocab(with_added_tokens=True):
        try:
            text = bytes(shown[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if text and text not in special:
            strings.append(text)
    single = regex.compile(PRE_TOKENS)
    out = {}
    for text, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False), strict=True):
        if len(e.ids) == 1 and single.fullmatch(text):
            out[text] = e.ids[0]
    return out


def byte_characters() -> dict[str, int]:
    """The character that byte-level BPE vocabularies show for each byte, by rule: itself where
    it prints, else the next unused one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counts(dict):
    """Pre-token -> number of tokens; the whole tokens are there from the start, the rest is merged when met."""

    def __init__(self, whole, merge):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge = len(self), merge

    def __missing__(self, piece):
        if len(self) >= self.whole + REMEMBERED:  # the whole tokens come first in the dictionary
            for old in list(self)[self.whole :]:
                del self[old]
        n = self[piece] = len(self.merge(piece.encode("utf-8", "surrogatepass")))
        return n


class Coder:
    """One vocabulary in one worker.

    Where every merge of the vocabulary yields the next id (checked here), merging by rank
    gives the library's ids, and tiktoken does that; otherwise the library itself is used.
    """

    def __init__(self, path, whole):
        self.library = tokenizer_at(path)
        self.cut = regex.compile(PRE_TOKENS).findall
        special = {t.content: t.special for t in self.library.get_added_tokens_decoder().values()}
        self.odd = re.compile("|".join([f"[^{SETTLED}]", *map(re.escape, special)])).search
        self.ranked = ranked_merger(path, special)
        self.counts = Counts(whole, self.ranked._core_bpe.encode_single_piece) if self.ranked else None

    def library_ids(self, text):
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def ids(self, text):
        """The text's ids, little-endian 32 bits each."""
        if self.ranked is None or self.odd(text):
            return self.library_ids(text)
        return np.frombuffer(self.ranked._core_bpe.encode_to_tiktoken_buffer(text, set()), dtype="<u4")

    def count(self, text):
        """Number of ids: whole tokens by lookup, the rest by merging."""
        if self.counts is None or self.odd(text):
            return len(self.library_ids(text))
        return sum(map(self.counts.__getitem__, self.cut(text)))


def ranked_merger(path, special):
    """tiktoken over the vocabulary's own ranks, or None where ranks and merges disagree."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown, vocab = byte_characters(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != vocab_at for vocab_at, (a, b) in enumerate(merges, 256)):
        return None
    try:
        ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items() if t not in special}
    except KeyError:
        return None
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def coder_for(path, whole=()):
    """One ``Coder`` per worker and vocabulary."""
    store = worker_store().setdefault("coders", {})
    if (path, len(whole)) not in store:
        store[path, len(whole)] = Coder(path, whole)
    return store[path, len(whole)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row; no shuffle."""
    whole = sorted(whole_tokens(tokenizer_path))

    def run(batches):
        coder = coder_for(tokenizer_path, whole)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                n_tokens.append(coder.count(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
