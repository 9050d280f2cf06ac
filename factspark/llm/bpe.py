"""BPE encoding and decoding by tree concatenation.

A long text is halved until its leaves are short. Leaves are rows of their own,
encoded on whatever executor gets them; then each pair of halves is joined by
encoding a window around the cut anew. The window grows to both sides until its
first and last pre-tokens are exactly those of the halves; then nothing beyond
them can change, because a pre-token depends on the text before it only through
where it starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_batches, table
from .tokens import BYTE_BPE, decimals, encoder, token_bytes

#: Characters of a leaf; texts of up to two leaves are not split.
LEAF = 16_384
WINDOW = 64


def _pretokens(text: str) -> list[int]:
    """Ends of the pre-tokens of a text, special tokens included."""
    import public_tokenizers
    import regex

    specials = "|".join(regex.escape(content) for content, _ in encoder(BYTE_BPE).specials)
    ends, at = [], 0
    # the library looks for special tokens first and pre-tokenizes what lies between them
    for special in [*regex.finditer(specials, text), None]:
        stop = special.start() if special else len(text)
        ends += [at + m.end() for m in regex.finditer(public_tokenizers.PATTERN, text[at:stop])]
        if special:
            ends.append(special.end())
            at = special.end()
    return ends


class Piece:
    """Encoded text: ids, and what to cut off near its ends again."""

    def __init__(self, text: str, ids: bytes) -> None:
        self.text, self.ids = text, ids


def encode_leaf(text: str) -> Piece:
    return Piece(text, encoder(BYTE_BPE).encode(text))


def concatenate(left: Piece, right: Piece) -> Piece:
    """The encoding of left.text + right.text, from theirs and a window around the cut.

    A window [a, b) is good if a starts a pre-token of left that the cut can't
    reach, and if some pre-token of the window that starts in right starts one
    of right's own. Ids before a and after that point are taken over as they are.
    """
    encode = encoder(BYTE_BPE).encode
    if not left.text or not right.text:
        return left if not right.text else right
    width, most = WINDOW, max(len(left.text), len(right.text))
    while True:
        whole_left, whole_right = width >= len(left.text), width >= len(right.text)
        tail, head = left.text[-width:], right.text[:width]
        starts_left = [0] if whole_left else _synced(left.text, tail)
        window_ends = _pretokens(tail[starts_left[0] :] + head) if starts_left else []
        if starts_left:
            cut = len(tail) - starts_left[0]
            own = {0, *_pretokens(head)}
            # the last own end may move with what follows the window
            own_sure = own if whole_right else {e for e in own if e <= len(head) - WINDOW // 2}
            window = tail[starts_left[0] :] + head
            # white space before an end looks at what follows, so such an end can't close the window
            common = [e - cut for e in window_ends[: None if whole_right else -1] if e >= cut and e - cut in own_sure and not window[e - 1 : e].isspace()]
            if common:
                b = common[0]
                a = len(left.text) - cut
                before, anew, after = encode(left.text[a:]), encode(left.text[a:] + right.text[:b]), encode(right.text[:b])
                # both sides agree: what is dropped from the halves is what they had there
                if left.ids.endswith(before) and right.ids.startswith(after):
                    return Piece(left.text + right.text, left.ids[: len(left.ids) - len(before)] + anew + right.ids[len(after) :])
        if whole_left and whole_right:
            text = left.text + right.text
            return Piece(text, encode(text))
        width = min(2 * width, most)


def _synced(text: str, tail: str) -> list[int]:
    """Places in tail where a pre-token of text surely starts: a space before a non-space, and no special token around."""
    if any(content in text[-len(tail) - 64 :] for content, _ in encoder(BYTE_BPE).specials):
        return []
    return [i for i in range(1, len(tail) - 1) if tail[i] == " " and not tail[i + 1].isspace() and not tail[i - 1].isspace()][:1]


def _leaf_texts(text: str, leaf: int) -> list[str]:
    """Halves of halves, down to the leaf size, in order."""
    if len(text) <= leaf:
        return [text]
    half = len(text) // 2
    return _leaf_texts(text[:half], leaf) + _leaf_texts(text[half:], leaf)


def join_leaves(leaves: list[Piece]) -> Piece:
    """Neighbours join pairwise, level by level."""
    while len(leaves) > 1:
        leaves = [concatenate(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def encode_text(text: str, leaf: int = LEAF) -> np.ndarray:
    """ids of a whole text."""
    if len(text) <= 2 * leaf:
        return np.frombuffer(encoder(BYTE_BPE).encode(text), "<u4")
    return np.frombuffer(join_leaves([encode_leaf(t) for t in _leaf_texts(text, leaf)]).ids, "<u4")


def decode_ids(ids: np.ndarray) -> str:
    """As the library's decode with skip_special_tokens=False."""
    return b"".join(map(token_bytes(BYTE_BPE).__getitem__, ids.tolist())).decode("utf-8", "replace")


def digests(ids: np.ndarray) -> tuple[int, str, str]:
    """(n_tokens, ids_sha256, decoded_sha256)."""
    names = decimals(len(token_bytes(BYTE_BPE)))
    return len(ids), hashlib.sha256(b",".join(map(names.__getitem__, ids.tolist()))).hexdigest(), hashlib.sha256(decode_ids(ids).encode()).hexdigest()


def _result(doc_ids, all_ids) -> pd.DataFrame:
    found = [digests(ids) for ids in all_ids]
    return pd.DataFrame({"doc_id": doc_ids, "n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]})


def _short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield _result(f["doc_id"], map(encode_text, f["text"]))


def _split(leaf: int):
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row, doc_id, text in zip(f["row"], f["doc_id"], f["text"]):
                parts = _leaf_texts(text, leaf)
                yield pd.DataFrame({"row": row, "doc_id": [doc_id] * len(parts), "part": range(len(parts)), "text": parts})

    return split


def _leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(ids=[encode_leaf(t).ids for t in f["text"]])


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    whole = join_leaves([Piece(t, i) for t, i in zip(group["text"], group["ids"])])
    return _result(group["doc_id"].iloc[:1].array, [np.frombuffer(whole.ids, "<u4")])


def encode_documents(docs: DataFrame, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids. Rows that repeat an id are encoded each on
    their own. Texts of over two leaves are shuffled as leaves; others are
    encoded where they are read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    # a row is named by its address, which is the same if a lost executor's part is computed again; ids are text in Python, see whole_text()
    rows = numbered(docs).select(F.concat_ws(":", "file", "place").alias("row"), F.col(f"row.`{id_col}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"))
    long = F.char_length("text") > 2 * leaf
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = rows.filter(~long).select("doc_id", "text").mapInPandas(_short, schema)
    parts = rows.filter(long).mapInPandas(_split(leaf), "row string, doc_id string, part int, text string")
    leaves = parts.repartition("row", "part").mapInPandas(_leaves, "row string, doc_id string, part int, text string, ids binary")
    every = short.unionByName(leaves.groupBy("row").applyInPandas(_joined, schema))
    return every.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"))
