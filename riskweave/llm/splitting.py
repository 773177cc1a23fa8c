"""Splitting oversized texts at natural boundaries (problem 8).

A text is laid out as the pieces of the vocabulary's split, with prefix sums of
their token counts. Cuts fall between pieces, so a part encodes to the tokens of its
stretch of the whole text (but for blanks at its end, which then are one piece and
counted as such). Boundaries are sorted arrays of piece
numbers by strength; the end of a part is found by binary search for the last
boundary under the limit, strongest kind first, and the next part begins by
stepping back over the overlap in the same way. A piece without any place to cut
that doesn't fit is cut hard by its prefix table; a part that begins within a piece
is laid out anew from there, until its pieces meet those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import DEFAULT_VOCAB, BytePairCodec, PrefixTable, codec, ship
from .tokens import _slices, count_tokens

#: Most tokens of a part.
MAX_TOKENS = 1024
#: Tokens that consecutive parts share at least (more if the nearest boundary lies further back).
OVERLAP = 64
#: A stronger boundary is preferred to a later one while the part is at least so full.
LEAST_FILL = 0.5

#: Kinds of boundary, strongest first.
KINDS = ("section", "paragraph", "line", "sentence", "word")
_SECTION = regex.compile(r"(?m)(?<=\n)(?===+[^\n]*=|\{\||#{1,6} )")
_PARAGRAPH = regex.compile(r"\n[ \t\r]*\n\s*")
_LINE = regex.compile(r"\r?\n|[\r  \u0085]")
_SENTENCE = regex.compile(r"[.!?…][\"'”’)\]]*(?=\s)|[。！？｡।؟]")
_WORD = regex.compile(r"(?<=\S)(?=\s)|(?<=\s)(?=\S)")
#: For each kind its pattern, and the side of a match where the cut lies.
_PLACES = ((_SECTION, "start"), (_PARAGRAPH, "end"), (_LINE, "end"), (_SENTENCE, "end"), (_WORD, "start"))


class Layout:
    """Pieces of one text: where they begin (in characters), and the tokens before each."""

    def __init__(self, tool: BytePairCodec, text: str):
        self.tool, self.text, self._found = tool, text, {}
        self.pieces = tool.pieces(text)
        known, fresh = tool.cache.get, tool.piece_ids
        self.sizes = [len(known(p) or fresh(p)) for p in self.pieces]
        self.total = sum(self.sizes)

    def place(self) -> None:
        """Works out the offsets; only texts over the limit need them."""
        self.chars = np.concatenate(([0], np.cumsum([len(p) for p in self.pieces], dtype=np.int64)))
        self.tokens = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))

    def standalone(self, start: int, end: int) -> int:
        """Tokens of the pieces start..end as a text of their own: blanks at its end become one piece."""
        at = end
        while at > start and self.pieces[at - 1].isspace():
            at -= 1
        size = int(self.tokens[at] - self.tokens[start])
        blank = "".join(self.pieces[at:end])
        return size + (len(self.tool.cache.get(blank) or self.tool.piece_ids(blank)) if blank else 0)

    def boundaries(self, kind: int) -> np.ndarray:
        """The sorted piece numbers before which the text may be cut at a boundary of a kind; found when first asked for."""
        if kind not in self._found:
            pattern, side = _PLACES[kind]
            places = np.asarray([getattr(m, side)() for m in pattern.finditer(self.text)], np.int64)
            at = np.searchsorted(self.chars, places)
            fits = (at < len(self.chars)) & (self.chars[np.minimum(at, len(self.chars) - 1)] == places)
            self._found[kind] = np.unique(at[fits])
        return self._found[kind]


def split_text(tool: BytePairCodec, text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP, fill: float = LEAST_FILL) -> list[tuple[int, int, int, str]]:
    """Parts (first character, end, tokens, how the end was found) of one text."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    lay = Layout(tool, text)
    total = lay.total
    if total <= limit:
        return [(0, len(text), total, "end")]
    lay.place()
    whole, origin, start, reached, window = lay, 0, 0, 0, 8 * limit
    out = []
    while True:
        tokens, chars, last = lay.tokens, lay.chars, len(lay.pieces)
        base, begin, complete = tokens[start], origin + int(chars[start]), origin + int(chars[-1]) == len(text)
        furthest = int(np.searchsorted(tokens, base + limit, "right")) - 1
        if furthest >= last - 1 and not complete:  # the layout ends too soon for this part
            window *= 2
            lay, origin, start = _laid_out(tool, text[begin : begin + window]), begin, 0
            continue
        if furthest >= last:
            out.append((begin, len(text), total - int(base) if lay is whole else lay.standalone(start, last), "end"))
            return out
        end, how = start, "hard"
        if furthest > start:
            low = base + int(limit * fill)
            end = furthest
            for floor in (low, base + overlap):  # full enough first; any boundary beyond the overlap rather than a hard cut
                for number, kind in enumerate(KINDS):
                    places = lay.boundaries(number)
                    k = int(np.searchsorted(places, furthest, "right")) - 1
                    if k >= 0 and tokens[places[k]] > floor and places[k] > start and origin + chars[places[k]] > reached:
                        end, how = int(places[k]), kind
                        break
                if how != "hard":
                    break
            size = lay.standalone(start, end)
            while size > limit and end > start + 1:  # a blank stretch may weigh more by itself
                end, how = end - 1, "hard"
                size = lay.standalone(start, end)
        stop = origin + int(chars[end])
        after = None
        if end > start and size <= limit and stop > reached:
            at = step_back(lay, start, end, overlap, limit)
            after = shared_from(tool, text, begin, stop, overlap, None if at is None else origin + int(chars[at]))
        if after is None:  # the next piece doesn't fit and has no place to cut, or the part is too short to share the overlap
            stop, size = hard_end(tool, text, begin, origin + int(chars[furthest]), lay.pieces[furthest], limit, max(begin, reached))
            how, after = "hard", stop
            if stop < len(text) and overlap:
                after = shared_from(tool, text, begin, stop, overlap) or stop
        out.append((begin, stop, size, how))
        if stop == len(text):
            return out
        reached = stop
        # back to the layout of the whole text where its pieces begin, else one of the text from here
        k = int(np.searchsorted(whole.chars, after))
        if whole.chars[k] == after:
            lay, origin, start = whole, 0, k
        else:
            window = max(8 * limit, window // 2)
            lay, origin, start = _laid_out(tool, text[after : after + window]), after, 0


def _laid_out(tool: BytePairCodec, text: str) -> Layout:
    lay = Layout(tool, text)
    lay.place()
    return lay


def step_back(lay: Layout, start: int, end: int, overlap: int, limit: int) -> int | None:
    """Where the next part begins: at least `overlap` tokens before `end`, at a boundary if one is near, after `start`.

    None if that is within a large piece.
    """
    tokens = lay.tokens
    if not overlap:
        return end
    latest = int(np.searchsorted(tokens, tokens[end] - overlap, "right")) - 1
    if latest <= start or tokens[end] - tokens[latest] > limit // 2:
        return None
    earliest = max(start + 1, int(np.searchsorted(tokens, tokens[end] - min(4 * overlap, limit // 2), "left")))
    for number in range(2, len(KINDS)):
        places = lay.boundaries(number)
        k = int(np.searchsorted(places, latest, "right")) - 1
        if k >= 0 and places[k] >= earliest:
            return int(places[k])
    return latest


def shared_from(tool: BytePairCodec, text: str, begin: int, stop: int, overlap: int, at: int | None = None) -> int | None:
    """`at` if at least `overlap` tokens lie between it and `stop`, else the last character that has them; None if there is none after `begin`."""
    if not overlap or at is not None and tool.count(text[at:stop]) >= overlap:
        return stop if at is None else at
    wide, most = overlap, stop - begin - 1
    while wide < most and tool.count(text[stop - wide : stop]) < overlap:
        wide *= 2
    wide = min(wide, most)
    if wide < 1 or tool.count(text[stop - wide : stop]) < overlap:
        return None
    low = 0
    while low + 1 < wide:
        middle = (low + wide) // 2
        low, wide = (low, middle) if tool.count(text[stop - middle : stop]) >= overlap else (middle, wide)
    return stop - wide


def hard_end(tool: BytePairCodec, text: str, begin: int, at: int, piece: str, limit: int, beyond: int) -> tuple[int, int]:
    """End and tokens of the part that begins at `begin` and ends within `piece`, which lies at `at`: as many whole characters as fit, by the prefix table."""
    spare = limit - (tool.count(text[begin:at]) if at > begin else 0)
    part = piece[: max(1, spare) * tool.longest]
    sizes = np.cumsum([len(c.encode("utf-8", "replace")) for c in part])
    table = PrefixTable(tool, part.encode("utf-8", "replace"))
    fits = np.nonzero(np.asarray(table.count)[sizes] <= spare)[0]
    stop = max(at + (int(fits[-1]) + 1 if len(fits) else 0), beyond + 1)
    size = tool.count(text[begin:stop])
    while size > limit and stop > beyond + 1:  # the beginning of a piece may split in another way by itself
        stop -= 1
        size = tool.count(text[begin:stop])
    return stop, size


def split_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_TOKENS, overlap: int = OVERLAP, vocab: str = DEFAULT_VOCAB, oversized_only: bool = True
) -> DataFrame:
    """(key, part_no, start_char, end_char, n_tokens, cut, part) of every text over `limit` tokens.

    With oversized_only False smaller texts come as one part. Null and empty texts have no part;
    a repeated row repeats its parts. Offsets count characters. Parts cover the whole text.
    Nothing is shuffled.
    """

    ship(df.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocab)
        for whole in batches:
            for batch in _slices(whole, "text", 4 << 20):
                rows: list[tuple] = []
                row_of: list[int] = []
                for n, value in enumerate(batch.column("text").to_pylist()):
                    # a text has at most as many tokens as bytes, so short ones need no count
                    if not value or oversized_only and len(value) * 4 <= limit:
                        continue
                    parts = split_text(tool, value, limit, overlap)
                    if oversized_only and len(parts) == 1:
                        continue
                    for no, (first, end, size, how) in enumerate(parts, 1):
                        row_of.append(n)
                        rows.append((no, first, end, size, how, value[first:end]))
                columns = list(zip(*rows)) if rows else [()] * 6
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(row_of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["key", "part_no", "start_char", "end_char", "n_tokens", "cut", "part"],
                )

    source = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, part_no int, start_char int, end_char int, n_tokens int, cut string, part string"
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_TOKENS, overlap: int = OVERLAP, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(key) of the texts that split_documents cuts: those whose second part exists."""
    return split_documents(df, key, text, limit, overlap, vocab).where("part_no = 2").select(key)


def joint_faults(parts: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_TOKENS, overlap: int = OVERLAP, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(key, n_parts, n_faults) of every text with parts: parts that begin late, end early, hold too much or share too little with the one before.

    parts: what `split_documents` gives for a unique key. The shared stretch of a joint is the end of the
    part before, counted anew by the vocabulary. One row a part is ordered within its text.
    """
    order = Window.partitionBy(key).orderBy("part_no")
    told = parts.select(
        key, "part_no", "start_char", "end_char", "n_tokens", "part", F.lag("end_char").over(order).alias("before"), F.lag("part").over(order).alias("part_before"), F.lead("part_no").over(order).isNull().alias("is_last")
    )
    shared = F.when(F.col("before") > F.col("start_char"), F.expr("right(part_before, before - start_char)")).otherwise("")
    own = told.select(key, "part_no", "start_char", "end_char", F.col("n_tokens").alias("n_own"), "before", "is_last", F.length("part").alias("size"), (F.expr("left(part, before - start_char)") == shared).alias("is_same"), shared.alias("shared"))
    counted = count_tokens(own, [c for c in own.columns if c != "shared"], "shared", vocab).withColumnRenamed("n_tokens", "n_shared")
    lengths = df.select(key, F.length(text).alias("__chars"))
    joined = counted.join(lengths, key)
    begins = F.when(F.col("before").isNull(), F.col("start_char") == 0).otherwise((F.col("n_shared") >= overlap) & F.col("is_same"))
    fine = begins & (F.col("n_own") <= limit) & (F.col("size") == F.col("end_char") - F.col("start_char")) & (~F.col("is_last") | (F.col("end_char") == F.col("__chars")))
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("n_parts"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("n_faults"))
