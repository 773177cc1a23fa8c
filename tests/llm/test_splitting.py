"""Parts of long texts: under the limit, whole, overlapping, at natural places."""

import pytest

from riskweave.llm import bpe, splitting

CODEC = bpe.codec()
PARAGRAPH = "The river runs past the old mill. It turns north there.\n" * 8


def parts_of(text, limit=128, overlap=16):
    parts = splitting.split_text(CODEC, text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b, n, _), (c, d, _, _) in zip(parts, parts[1:]):
        assert a < c <= b < d, "parts overlap or touch, and go on"
        assert CODEC.count(text[c:b]) >= overlap
    for a, b, n, _ in parts:
        assert CODEC.count(text[a:b]) == n <= limit
    return parts


@pytest.mark.parametrize(
    "text",
    [
        (PARAGRAPH + "\n== Part ==\n") * 6, "word " * 3000, "x" * 4000, "漢字" * 900, "=" * 9000, "\n" * 5000, "a" * 1500 + " tail " * 400, "no.stops,here;" * 500, "日本語の文。" * 400, "\r\n".join(["line of a table || 5"] * 300), "👩‍👩‍👧" * 300,
    ],
)
def test_parts(text):
    assert len(parts_of(text)) > 1


@pytest.mark.parametrize(
    "text",
    [
        "x" * 4000, "漢字" * 900, "=" * 20000, "\n" * 5000, "a" * 1500 + " tail " * 400, PARAGRAPH * 2 + "q" * 900 + PARAGRAPH * 2, "👩‍👩‍👧" * 300, "some words " + "z" * 850 + " " + "y" * 850 + " and more" * 90,
        ("=-" * 130 + "\n") * 9, PARAGRAPH + "=" * 9000 + "abc " * 300 + "\r\n" * 900 + "end. " * 100, (" " * 700 + "ab") * 9, "abc\t \n" * 900, "ЖЩ" * 700 + "!?" * 500,
    ],
)
@pytest.mark.parametrize(("limit", "overlap"), [(128, 16), (1024, 64), (100, 45), (64, 0)])
def test_every_joint_overlaps(text, limit, overlap):
    parts = splitting.split_text(CODEC, text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(CODEC.count(text[a:b]) == n <= limit for a, b, n, _ in parts)
    for (a, b, _, _), (c, d, _, _) in zip(parts, parts[1:]):
        assert a < c <= b < d and CODEC.count(text[c:b]) >= overlap


def test_small_texts_are_one_part():
    assert splitting.split_text(CODEC, "short", 128, 16) == [(0, 5, 1, "end")]


def test_cuts_prefer_strong_boundaries():
    text = (PARAGRAPH + "\n== Part ==\n") * 6
    hows = [p[3] for p in parts_of(text, 256, 16)]
    assert "section" in hows[:-1] and "hard" not in hows and "word" not in hows


def test_overlap_steps_back_to_boundaries():
    text = "One two three four five. " * 200
    for (_, end, _, _), (start, _, _, _) in zip(parts_of(text), parts_of(text)[1:]):
        assert text[start - 1] in " ." and 16 <= CODEC.count(text[start:end]) <= 64


def test_bad_overlap_is_refused():
    with pytest.raises(ValueError):
        splitting.split_text(CODEC, "x", 100, 50)


def test_faults_are_found(spark):
    df = spark.createDataFrame([(1, "word " * 3000), (2, "x" * 9000), (3, "short"), (4, None)], "doc_id bigint, text string")
    parts = splitting.split_documents(df, oversized_only=False)
    sound = {r.doc_id: r for r in splitting.joint_faults(parts, df).collect()}
    assert set(sound) == {1, 2, 3} and not any(r.n_faults for r in sound.values()) and sound[3].n_parts == 1
    for change in ("start_char + IF(part_no = 2, 200, 0)", "start_char + IF(part_no = 1, 1, 0)"):
        bad = parts.selectExpr("doc_id", "part_no", f"{change} AS start_char", "end_char", "n_tokens", "cut", "part")
        assert {r.doc_id: r.n_faults > 0 for r in splitting.joint_faults(bad, df).collect()}[1]
    assert {r.n_faults for r in splitting.joint_faults(parts.where("part_no > 1"), df).collect()} != {0}
    assert splitting.joint_faults(parts.limit(0), df).count() == 0


def test_split_documents(spark):
    rows = [(1, "word " * 3000, "clash"), (2, "short", None), (3, None, None), (4, "", None), (1, "word " * 3000, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part string")
    parts = splitting.split_documents(df).collect()
    assert {p.doc_id for p in parts} == {1} and max(p.n_tokens for p in parts) <= 1024 and len(parts) % 2 == 0
    assert [r.doc_id for r in splitting.oversized(df).collect()] == [1, 1]
    assert splitting.oversized(df.limit(0)).count() == 0
    assert {p.doc_id for p in splitting.split_documents(df, oversized_only=False).collect()} == {1, 2}
