"""Problem 6: token ids of the whole corpus by a public byte-level BPE vocabulary, each repeated chunk of text encoded once.

Texts are cut where a rolling hash of the last bytes says so, so texts that share a passage share its chunks. The distinct chunks of the corpus are
encoded once; a text's ids are its chunks' ids with the joins repaired. What a tokenizer does at a chunk's end depends on what follows, and a cut may
fall inside a word: at each join the text from the last certain word bound of the left side is encoded anew until a word bound of the right side
agrees, from where the right side's ids hold.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spansense.runtime import spread, wide

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the published word pattern of the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Cuts: the bytes that the rolling hash sees, the mean distance of cuts as a power of two, and the least and most bytes between two.
WINDOW, MEAN_BITS, LEAST, MOST = 16, 11, 256, 16_384

#: Bytes of texts that are searched for cuts at once.
BLOCK_BYTES = 4 << 20

#: A chunk that stands this often in one Arrow batch is hot: its texts go to one of so many tasks, each of which encodes it.
HOT_IN_BATCH, HOT_TASKS = 64, 64

#: Characters that the word pattern looks at beyond a word's end, at most ("'ll" is told from "'" by two more).
LOOKAHEAD = 3


@lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary at ``path``, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def cut_points(data: np.ndarray, *, window: int = WINDOW, mean_bits: int = MEAN_BITS) -> np.ndarray:
    """Candidate cuts of a buffer: positions after which a chunk may end, told by a rolling hash of the ``window`` bytes before.

    The hash of position i is the sum of a fixed random number per byte, shifted by the byte's distance; it needs ``window`` vector additions.
    """
    gear = np.random.default_rng(20240901).integers(0, 2**32, 256, dtype=np.uint32)
    g = gear[data]
    h = np.zeros(len(data), np.uint32)
    for k in range(min(window, len(data))):
        h[k:] += g[: len(g) - k] << np.uint32(k) if k else g
    return np.flatnonzero((h >> np.uint32(window)) & np.uint32((1 << mean_bits) - 1) == 0) + 1


def cuts_of(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of each text and its cuts, found over blocks of texts at once.

    What the hash of a text's first bytes sees of the text before it doesn't matter: no chunk is shorter than the hash's window.
    """
    assert LEAST > WINDOW
    first = 0
    while first < len(raws):
        last, size = first, 0
        while last < len(raws) and (last == first or size + len(raws[last]) <= BLOCK_BYTES):
            size += len(raws[last])
            last += 1
        data = np.frombuffer(b"".join(raws[first:last]), np.uint8)
        cuts = cut_points(data)
        ends = np.cumsum([len(r) for r in raws[first:last]])
        places = np.searchsorted(cuts, ends)
        at = since = 0
        for end, place in zip(ends.tolist(), places.tolist()):
            yield data[at:end], cuts[since:place] - at
            at, since = end, place
        first = last


def chunk_bounds(size: int, cuts: np.ndarray, data: np.ndarray, *, least: int = LEAST, most: int = MOST) -> list[int]:
    """The ends of a text's chunks, on character bounds, ``least`` to about ``most`` bytes apart; the last is ``size``."""
    ends, at = [], 0
    i = 0
    cuts = cuts.tolist()
    while size - at > least:
        while i < len(cuts) and cuts[i] < at + least:
            i += 1
        end = min(cuts[i] if i < len(cuts) else size, at + most, size)
        while end < size and (int(data[end]) & 0xC0) == 0x80:
            end += 1
        if end >= size:
            break
        ends.append(end)
        at = end
    ends.append(size)
    return ends


_PIECE = "k1 bigint, k2 bigint, salt int, whole boolean, chunk binary, places array<struct<doc_id:bigint,row:bigint,seq:int>>"
_PLACE = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int32())])


def split_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, row, text)`` to a row per batch and distinct chunk: its hashes, its bytes and the places where it stands.

    ``whole`` tells chunks that are a text of their own from parts of texts; a null or empty text is one empty chunk. Repeats within a batch are put together here, so a chunk of very many texts is moved once a batch.
    """
    for batch in batches:
        places: dict[tuple[bool, bytes], list[tuple]] = {}
        raws = [(text or "").encode() for text in batch.column(2).to_pylist()]
        for doc, row, raw, (data, cuts) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raws, cuts_of(raws), strict=True):
            at = 0
            ends = chunk_bounds(len(raw), cuts, data) if len(raw) > LEAST else [len(raw)]
            for seq, end in enumerate(ends):
                places.setdefault((len(ends) == 1, raw[at:end]), []).append((doc, row, seq))
                at = end
        keys = list(places)
        hashes = [xxhash.xxh3_128_digest(c) for _, c in keys]
        halves = np.frombuffer(b"".join(hashes), ">i8").astype("<i8").reshape(-1, 2)
        salts = [places[k][0][1] % HOT_TASKS if len(places[k]) >= HOT_IN_BATCH else 0 for k in keys]
        flat = [p for k in keys for p in places[k]]
        offsets = np.cumsum([0, *[len(places[k]) for k in keys]]).astype(np.int32)
        columns = list(zip(*flat)) or [(), (), ()]
        items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACE)], fields=list(_PLACE))
        yield pa.RecordBatch.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(salts, pa.int32()), pa.array([w for w, _ in keys], pa.bool_()), pa.array([c for _, c in keys], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), items)],
            ["k1", "k2", "salt", "whole", "chunk", "places"],
        )


_WORDS = regex.compile(WORDS)


class Words:
    """Ids word by word. A prefix that ends between two words must not be encoded as one text: at its end the pattern would match otherwise."""

    def __init__(self, enc) -> None:
        self.enc, self.known = enc, {}

    def ids(self, word: str) -> list[int]:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self.enc.encode_ordinary(word)
        return self.known[word]

    def prefix(self, text: str, end: int) -> list[int]:
        """The ids of the words of ``text`` before its word bound ``end``."""
        out: list[int] = []
        for m in _WORDS.finditer(text):
            if m.start() >= end:
                break
            out += self.ids(m.group())
        return out


def _word_starts(text: str) -> list[int]:
    return [m.start() for m in _WORDS.finditer(text)]


def certain_bound(text: str) -> int:
    """The last word bound that nothing which may follow ``text`` can move, 0 if there is none.

    The pattern never looks back, so a bound stands if no word before it was matched by a look past the end.
    """
    last = 0
    for m in _WORDS.finditer(text):
        if m.start() > len(text) - LOOKAHEAD:
            break
        last = m.start()
    return last


def encode_chunk(enc, text: str) -> tuple[list[int], int]:
    """A chunk's ids, and how many of them lie before its last certain bound."""
    ids = enc.encode_ordinary(text)
    at = certain_bound(text)
    return ids, len(ids) - len(enc.encode_ordinary(text[at:])) if at else 0


def _lists(lists: list[list[int]]) -> pa.Array:
    """Lists of ids as an Arrow column, without an object per id."""
    offsets = np.cumsum([0, *map(len, lists)], dtype=np.int64)
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def encode_whole(path: str, counts: bool):
    """Chunks that are texts to ``(doc_id, ids)``, or with ``counts`` ``(doc_id, tokens)``: rows come ordered by chunk, so each is encoded once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last, ids = encoding(path), None, []
        for batch in batches:
            docs, lists = [], []
            for whole, chunk, places in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if not whole:
                    continue
                if chunk != last:
                    last, ids = chunk, enc.encode_ordinary(chunk.decode())
                docs += [p["doc_id"] for p in places]
                lists += [len(ids) if counts else ids] * len(places)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lists, pa.int64()) if counts else _lists(lists)], ["doc_id", "tokens" if counts else "ids"])

    return run


def encode_parts(path: str):
    """Chunks that are parts of texts to ``(doc_id, row, seq, ids, keep)``, each encoded once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last, coded = encoding(path), None, ([], 0)
        for batch in batches:
            rows, lists, keeps = [], [], []
            for whole, chunk, places in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if whole:
                    continue
                if chunk != last:
                    last, coded = chunk, encode_chunk(enc, chunk.decode())
                rows += places
                lists += [coded[0]] * len(places)
                keeps += [coded[1]] * len(places)
            cols = [pa.array([r[n] for r in rows], t) for n, t in (("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, _lists(lists), pa.array(keeps, pa.int32())], ["doc_id", "row", "seq", "ids", "keep"])

    return run


def _agreement(window: str, right: str, at: int) -> int | None:
    """The first word bound, at or after ``at``, that ``window`` and ``right``, which starts there, have in common and that is certain."""
    last = len(window) - LOOKAHEAD
    mine, own = _WORDS.finditer(window), _WORDS.finditer(right)
    a = next((m.start() for m in mine if m.start() >= at), None)
    b = 0
    while a is not None and b is not None and a <= last:
        if a - at == b:
            return a
        if a - at < b:
            a = next((m.start() for m in mine), None)
        else:
            b = next((m.start() for m in own if m.start() > b), None)
    return None


def join_chunks(words: Words, parts: list[tuple[list[int], int]]) -> list[int]:
    """The ids of the concatenated texts of ``parts``, each the ids of one chunk's text and the number before its last certain bound.

    From the left side's last certain bound on the words are matched anew; as soon as one starts where a word of the right side starts, the
    right side's own words, and so its ids, follow. A right side that never agrees is encoded anew as a whole.
    """
    enc = words.enc
    out: list[int] = []
    kept, tail = 0, ""  # the text of out[kept:] is tail, which starts at a certain bound
    for ids, keep in parts:
        if not ids:
            continue
        if not out:
            out, kept = list(ids), keep
            tail = enc.decode(ids[keep:])
            continue
        right = enc.decode(ids)
        window = tail + right
        agree = _agreement(window, right, len(tail))
        if agree is None:
            out[kept:] = enc.encode_ordinary(window)
            at = certain_bound(window)
            kept, tail = kept + len(words.prefix(window, at)), window[at:]
            continue
        skip = len(words.prefix(right, agree - len(tail)))
        out[kept:] = words.prefix(window, agree)
        kept = len(out)
        out += ids[skip:]
        if keep > skip:
            kept, tail = len(out) - len(ids) + keep, enc.decode(ids[keep:])
        else:
            at = certain_bound(window[agree:])
            kept, tail = kept + len(words.prefix(window[agree:], at)), window[agree + at :]
    return out


def join_documents(path: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(encoding(path))
        for batch in batches:
            ids, keeps = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lists = [join_chunks(words, list(zip(i, k))) for i, k in zip(ids, keeps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in lists], pa.int64()) if counts else _lists(lists)], ["doc_id", "tokens" if counts else "ids"])

    return run


def _encoded(documents: DataFrame, path: str, counts: bool) -> DataFrame:
    """The ids, or their numbers, of each row.

    Chunks move once, put together by task; those that are texts end there. Only parts of longer texts move again, as ids, to be joined. Both read the same shuffled chunks.
    """
    n = wide(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    # the row's own number keeps rows with one doc_id apart; in its order batches, and so hot chunks, are the same whenever a task is run again
    pieces = spread(rows, "row").mapInArrow(split_chunks, _PIECE).repartition(n, "k1", "k2", "salt").sortWithinPartitions("k1", "k2")
    out = "doc_id bigint, tokens bigint" if counts else "doc_id bigint, ids array<int>"
    whole = pieces.mapInArrow(encode_whole(path, counts), out)
    parts = pieces.mapInArrow(encode_parts(path), "doc_id bigint, row bigint, seq int, ids array<int>, keep int")
    lists = parts.repartition(n, "row").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("seq", "ids", "keep"))).alias("parts"))
    joined = lists.select("doc_id", F.col("parts.ids").alias("ids"), F.col("parts.keep").alias("keeps")).mapInArrow(join_documents(path, counts), out)
    return whole.unionByName(joined)


def token_ids(documents: DataFrame, *, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id BIGINT, ids ARRAY<INT>)``: one row per row of ``documents``, without special tokens.

    Null and empty texts give an empty list; texts of special tokens are ordinary text; repeated rows come out repeatedly. Every distinct chunk of
    the corpus is encoded once, wherever it occurs (a hot one in up to ``HOT_TASKS`` tasks); chunks meet by a 128-bit hash and are compared by their bytes.
    """
    return _encoded(documents, f"{tokenizers}/{vocabulary}", False)


def decoded(ids: DataFrame, *, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, digest)``: SHA-256 of the text that each list of ids stands for, in hexadecimal."""
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            digests = [hashlib.sha256(enc.decode_bytes(x)).hexdigest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["doc_id", "digest"])

    return ids.mapInArrow(run, "doc_id bigint, digest string")


def token_counts(documents: DataFrame, *, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, tokens)``: the number of ids of each row; the ids themselves stay in the tasks."""
    return _encoded(documents, f"{tokenizers}/{vocabulary}", True)


def p6_ids(documents: DataFrame) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return token_ids(documents)
