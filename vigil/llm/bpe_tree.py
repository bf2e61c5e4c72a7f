"""Operator 1: BPE encoding and decoding by tree concatenation.

Long texts are cut into leaves at fixed character positions. Leaves are encoded by different tasks, then
joined pairwise up a tree. A node keeps the ids that no further text can change, and at either side the
*fragment* of text up to the first white space. Two neighbouring nodes join their touching fragments: a
window of tokens around the join is encoded anew and grows until it shares a run of tokens with the
encoding on each side; there the three are spliced.

Why a shared run suffices: a token sequence is the BPE encoding of its text exactly when each two
neighbours are the encoding of their own concatenation. In the spliced sequence every two neighbours
stand side by side in the encoding of the left fragment, of the window, or of the right fragment. The
last token of a window or fragment carries the end-of-word mark and is never part of a shared run.

Defined results: null or empty text gives no ids and an empty decoded text; repeated rows each give a
row; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import by_bytes, spread, table, trimmed
from vigil.llm.textcodec import LITTLE, PLAIN, WORD_KIND, WORD_SPLIT, Memo, encode_units, memo, model_encoder, require, tokenizer

#: Characters in a leaf. Longer texts are encoded by several tasks.
LEAF_CHARS = 32_768
#: Tokens on each side of a join that the first window takes.
WINDOW = 8
#: Tokens that a window must share with each side.
SHARED = 2

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass
class Fragment:
    """Text without a sure pre-token boundary, and its encoding as if it stood alone."""

    text: str
    ids: list[int]
    spans: list[tuple[int, int]]


@dataclass
class Node:
    """``left`` fragment, settled ``ids``, ``right`` fragment; ``open`` nodes have one fragment only."""

    left: Fragment
    ids: bytes | None
    right: Fragment | None

    @property
    def open(self) -> bool:
        return self.ids is None


def fragment(path: str, text: str) -> Fragment:
    e = tokenizer(path).encode(text, add_special_tokens=False)
    return Fragment(text, e.ids, e.offsets)


def _meet(a: Fragment, b: Fragment, shift: int, low: int, high: int, last_a: bool) -> tuple[int, int] | None:
    """First run of SHARED tokens with equal ids and places in ``a`` and ``b`` (b's places + shift)."""
    at = {}
    stop = len(a.ids) - (0 if last_a else 1)
    for i in range(stop):
        at[a.ids[i], a.spans[i][0], a.spans[i][1]] = i
    for j in range(low, high):
        i = at.get((b.ids[j], b.spans[j][0] + shift, b.spans[j][1] + shift))
        if i is not None and i + SHARED <= stop and all(
            j + k < high and (a.ids[i + k], a.spans[i + k][0], a.spans[i + k][1]) == (b.ids[j + k], b.spans[j + k][0] + shift, b.spans[j + k][1] + shift)
            for k in range(SHARED)
        ):
            return i, j
    return None


def join_fragments(path: str, a: Fragment, b: Fragment) -> Fragment:
    """The exact encoding of ``a.text + b.text``."""
    if not a.text:
        return b
    if not b.text:
        return a
    text, n, w = a.text + b.text, len(a.text), WINDOW
    while True:
        i, j = len(a.ids) - w, w
        if i <= 0 or j >= len(b.ids) - 1:
            return fragment(path, text)
        start, end = a.spans[i][0], n + b.spans[j][1]
        win = fragment(path, text[start:end])
        win.spans = [(s + start, e + start) for s, e in win.spans]
        # the window's own last token, and those of the left fragment, carry a false end of word
        left = _meet(Fragment("", win.ids[:-1], win.spans[:-1]), a, 0, i, len(a.ids) - 1, True)
        right = _meet(Fragment("", win.ids[:-1], win.spans[:-1]), b, n, 0, j, True)
        if left and right and left[0] <= right[0]:
            (wi, ai), (wj, bj) = left, right
            ids = a.ids[:ai] + win.ids[wi:wj] + b.ids[bj:]
            spans = a.spans[:ai] + win.spans[wi:wj] + [(s + n, e + n) for s, e in b.spans[bj:]]
            return Fragment(text, ids, spans)
        w *= 2


def units_of(text: str) -> list[str]:
    """Blanks and line feeds are dropped by the pre-tokenizer wherever they stand, so both sides are alone."""
    return text.replace("\n", " ").split(" ")


def _names(path: str) -> list[str]:
    return memo("names", path, lambda p: lambda _: [tokenizer(p).id_to_token(i) for i in range(tokenizer(p).get_vocab_size())])[""]


def decode_ids(path: str, ids) -> str:
    """Text of ids as the library's ``decode(ids, skip_special_tokens=False)`` (without a decoder in the file: tokens joined by blanks)."""
    tok = tokenizer(path)
    if tok.decoder is not None:
        return tok.decode(list(ids), skip_special_tokens=False)
    return " ".join(map(_names(path).__getitem__, ids))


def _lower_split(text: str) -> list[str]:
    return WORD_SPLIT(text.lower())


def word_memo(path: str) -> Memo:
    """Pre-token -> (ids as bytes, decoded tokens)."""

    def make(path):
        ids_of = model_encoder(path)

        def encode(word):
            i = ids_of(word)
            return i, decode_ids(path, memoryview(i).cast("I") if LITTLE else np.frombuffer(i, "<u4").tolist()).encode()

        return encode

    return memo("word", path, make)


def encode_texts(path: str, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
    """(ids, decoded UTF-8) of each whole text."""
    split: dict = {}
    units: set[str] = set()
    out = [(b"", b"")] * len(texts)
    get = word_memo(path).__getitem__
    for i, t in enumerate(texts):
        if t and PLAIN(t) and "<|" not in t:
            got = list(map(get, _lower_split(t)))
            out[i] = (b"".join([g[0] for g in got]), b" ".join([g[1] for g in got]))
        elif t:
            split[i] = parts = units_of(t)
            units.update(parts)
    if split:
        ids = dict(zip(units, encode_units(path, _lower_split, list(units)), strict=True))
        for i, parts in split.items():
            whole = b"".join(map(ids.__getitem__, parts))
            out[i] = (whole, decode_ids(path, np.frombuffer(whole, "<u4").tolist()).encode())
    return out


def leaf(path: str, text: str) -> Node:
    """A cut-out piece of a text as a node of the tree."""
    if text in (own := specials(path)):
        return Node(Fragment("", [], []), _u4([own[text]]), Fragment("", [], []))
    flat = text.replace("\n", " ")
    first, last = flat.find(" "), flat.rfind(" ")
    if first < 0:
        return Node(fragment(path, text), None, None)
    (ids, _), = encode_texts(path, [text[first:last]])
    return Node(fragment(path, text[:first]), ids, fragment(path, text[last + 1 :]))


def _u4(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def join_nodes(path: str, a: Node, b: Node) -> Node:
    if a.open and b.open:
        return Node(join_fragments(path, a.left, b.left), None, None)
    if a.open:
        return Node(join_fragments(path, a.left, b.left), b.ids, b.right)
    if b.open:
        return Node(a.left, a.ids, join_fragments(path, a.right, b.left))
    return Node(a.left, a.ids + _u4(join_fragments(path, a.right, b.left).ids) + b.ids, b.right)


def root_ids(path: str, nodes: list[Node]) -> bytes:
    """Join neighbours level by level until one node is left."""
    while len(nodes) > 1:
        nodes = [join_nodes(path, *nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    if not nodes:
        return b""
    n = nodes[0]
    return _u4(n.left.ids) if n.open else _u4(n.left.ids) + n.ids + _u4(n.right.ids)


def specials(path: str) -> dict[str, int]:
    """Strings that the library takes out of a text before anything else, with their ids."""

    def make(path):
        added = tokenizer(path).get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path} has added tokens that depend on their neighbours")
        return lambda _: {t.content: i for i, t in added.items()}

    return memo("specials", path, make)[""]


def cut(text: str, chars: int = LEAF_CHARS, own: dict[str, int] | None = None) -> list[str]:
    """Pieces of at most ``chars`` characters; the strings ``own`` are pieces of their own, whatever their length."""
    if not own or "<|" not in text:
        return [text[i : i + chars] for i in range(0, len(text), chars)]
    parts = re.split("(" + "|".join(re.escape(x) for x in sorted(own, key=len, reverse=True)) + ")", text)
    return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else cut(part, chars))]


def _digest(doc_id: list, pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array([len(i) // 4 for i, _ in pairs], pa.int64()), pa.array([sha(i) for i, _ in pairs], pa.string()), pa.array([sha(d) for _, d in pairs], pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _short(path: str, step: int = 256):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, step):
                c = b.slice(at, step)
                yield _digest(c.column("doc_id").to_pylist(), encode_texts(path, c.column("text").to_pylist()))

    return run


def pack(node: Node) -> list[bytes | None]:
    out: list[bytes | None] = [node.ids]
    for f in (node.left, node.right):
        out += [None, None, None] if f is None else [f.text.encode("utf-8", "surrogatepass"), _u4(f.ids), np.array(f.spans, dtype="<i8").tobytes()]
    return out


def unpack(row) -> Node:
    def frag(text, ids, spans):
        if text is None:
            return None
        return Fragment(bytes(text).decode("utf-8", "surrogatepass"), np.frombuffer(ids, "<u4").tolist(), [tuple(x) for x in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()])

    return Node(frag(*row[1:4]), None if row[0] is None else bytes(row[0]), frag(*row[4:7]))


NODE = ["settled", "lt", "li", "ls", "rt", "ri", "rs"]


def _pieces(path: str, chars: int):
    def run(batches):
        for whole in batches:
            for b in by_bytes(whole):
                for row, doc, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    got = cut(text, chars, specials(path))
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(got), pa.int64()), pa.array([doc] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.string())], ["row", "doc_id", "pos", "text"])

    return run


def _leaves(path: str):
    def run(batches):
        for b in batches:
            rows = [pack(leaf(path, t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("pos"), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(len(NODE))]], ["row", "doc_id", "pos", *NODE])

    return run


def _roots(path: str):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        cols = [t.column(c).to_pylist() for c in NODE]
        ids = root_ids(path, [unpack(r) for r in zip(*cols, strict=True)])
        text = decode_ids(path, np.frombuffer(ids, "<u4").tolist()).encode()
        return pa.Table.from_batches([_digest(t.column("doc_id").to_pylist()[:1], [(ids, text)])])

    return run


def encode_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row of digests for each row of ``docs`` (doc_id, text); the ids themselves come from ``encode_ids``."""
    require(path, WORD_KIND)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > leaf_chars, F.lit(False))
    short = base.where(~long).mapInArrow(trimmed(_short(path)), SCHEMA)
    tall = base.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = tall.mapInArrow(_pieces(path, leaf_chars), "row long, doc_id long, pos int, text string")
    nodes = spread(pieces, "row", "pos").mapInArrow(trimmed(_leaves(path)), "row long, doc_id long, pos int, " + ", ".join(f"{c} binary" for c in NODE))
    return short.unionByName(nodes.groupBy("row").applyInArrow(_roots(path), SCHEMA))


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded: the real output for texts that fit a task (any length, one row each)."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            short = encode_texts(path, [t if len(t or "") <= LEAF_CHARS else "" for t in texts])
            pairs = [(root_ids(path, [leaf(path, c) for c in cut(t, LEAF_CHARS, specials(path))]) if len(t or "") > LEAF_CHARS else p, None) for t, (p, _) in zip(texts, short, strict=True)]
            ids = [np.frombuffer(p, "<u4").astype("i4") for p, _ in pairs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.tolist() for i in ids], pa.list_(pa.int32())), pa.array([decode_ids(path, i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_tree(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_path())
