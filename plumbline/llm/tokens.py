"""Token counts and ids of whole texts: overlapping chunks of huge documents, spliced where both encodings must agree."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: UTF-8 bytes of a chunk, and of its first overlap with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: A place where a white-space byte follows a visible ASCII byte. No pre-token of the vocabularies read here holds a
#: visible character followed by white space, and no special string holds white space at all; so whatever stands
#: before or after, a pre-token ends there.
STABLE = re.compile(rb"(?<=[!-~])[ \n]")


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Callable[[str], list[int]], np.ndarray | None, Callable[[str], list[int]]]:
    """encode(text) -> ids as the file's own library gives them, the bytes each id stands for (None: not byte-level),
    and an encode whose time stays in proportion for words of millions of characters.

    A byte-level BPE .json without normaliser is run by tiktoken on the ranks that the file's own ids give. Its ids
    equal those of the `tokenizers` library (tests compare both) at a quarter of the CPU time.
    """
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return piece.encode, None, piece.encode
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not spec.get("normalizer") and not spec.get("truncation") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not model.get("ignore_merges")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    library = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return library, None, library
    import tiktoken
    from public_tokenizers import PATTERN

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as themselves,
    hidden = [b for b in range(256) if b not in visible]  # and the others as the characters from 256 on
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    for token, i in special.items():
        lengths[i] = len(token.encode())
    return lambda text: encoding.encode(text, allowed_special="all"), lengths, library


def _cut(raw: bytes, at: int) -> int:
    """The first place from `at` on where a character begins."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def encode_whole(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of the whole text. Texts longer than `chunk` bytes are encoded as overlapping chunks.

    Two neighbours are spliced at the first token boundary of both that is STABLE and lies at least one further
    token inside each; if the overlap has none, it is doubled, at worst up to the whole rest of the text.
    """
    encode, lengths, patient = encoder(path)
    if lengths is None or len(text) * 4 <= chunk or len(raw := text.encode("utf-8")) <= chunk + overlap:
        return np.asarray(encode(text), np.uint32)
    def opened(begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        known = encode if end - begin <= 2 * chunk else patient
        ids = np.asarray(known(raw[begin:end].decode("utf-8")), np.uint32)
        return ids, begin + np.cumsum(lengths[ids])

    parts: list[np.ndarray] = []
    begin, width, end = 0, overlap, _cut(raw, chunk + overlap)
    ids, at = opened(begin, end)
    while end < len(raw):
        start = _cut(raw, end - width)
        stop = _cut(raw, min(len(raw), start + chunk + overlap))
        following, follows = opened(start, stop)
        stable = [m.start() for m in STABLE.finditer(raw, start + 1, end)]
        common = np.intersect1d(np.intersect1d(at[:-1], follows[:-1]), np.asarray(stable, np.int64))
        if common.size:
            begin = int(common[0])
            parts.append(ids[: int(np.searchsorted(at, begin, "right"))])
            first = int(np.searchsorted(follows, begin, "right"))
            ids, at, end, width = following[first:], follows[first:], stop, overlap
        else:
            width *= 2
            end = _cut(raw, min(len(raw), begin + chunk + width))
            ids, at = opened(begin, end)
    return np.concatenate([*parts, ids])


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null key stays null; repeated rows are counted each; no rows
    give no rows. Other columns are not read, whatever their names. Special strings inside texts count as the
    library counts them by default. Each text is encoded within one row of one task; there is no shuffle.
    """
    path = vocabulary or default_vocabulary()
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [len(encode_whole(t, path)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(count, schema)
