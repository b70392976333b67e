"""Line dedup against a plain version: runs of one, two, three and more lines, by their words."""

import random

import pytest

from tickloom.llm.line_dedup import BYTES_OF_WORD, minimum, remove_repeated_lines, weighed, windows


def plain(texts, words):
    """The text that is left of each: a line goes with any long enough run that stood before."""
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        body = [lines[i].strip() for i in full]
        weights = [max(len(x.split()), len(x.encode()) // BYTES_OF_WORD) for x in body]
        gone = set()
        for b in range(1, len(body) + 1):
            for a in range(b):
                if sum(weights[a:b]) >= words:
                    if tuple(body[a:b]) in seen:
                        gone |= set(range(full[a], full[b - 1] + 1))
                    seen.add(tuple(body[a:b]))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def left(spark, texts, words):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.text for r in remove_repeated_lines(docs, words).orderBy("doc_id").collect()]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_runs_of_few_lines(spark, n):
    run = [f"line {k} of a passage that comes again" for k in range(n)]
    texts = ["\n".join(["first a b", *run, "last a b"]), "\n".join(["first c d", *run, "last c d"]), "\n".join([*run, *run])]
    assert left(spark, texts, 3) == [texts[0], "first c d\nlast c d", ""]


def test_parts_with_other_first_places(spark):
    """The lines of the third text's run stand first in two texts, the run itself in a third."""
    texts = ["a\nown one two three", "b\nown four five six", "x\na\nb\nc\ny", "p\na\nb\nc\nq", "z\na"]
    assert left(spark, texts, 3) == [*texts[:3], "p\nq", texts[4]]


@pytest.mark.parametrize("words", [1, 3, 12])
def test_as_plain(spark, words):
    r = random.Random(words)
    short = ["a", "b c", "  a ", "d e f", "", " ", "g h i j k", "漢字" * 12]
    passages = [[f"p{i} {k} " + "w " * r.randrange(8) for k in range(1 + i % 4)] for i in range(8)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(5)):
            lines += r.choice([[r.choice(short)], r.choice(passages), [f"own {i} {r.random()}"]])
        texts.append("\n".join(lines))
    assert left(spark, texts, words) == plain(texts, words)


@pytest.mark.parametrize("words", [2, 5, 9])
def test_windows_guarantee_fingerprints(words):
    """Texts that share a run of so many words select the same lines of it, wherever it stands; of short lines only some are selected."""
    r, some, every = random.Random(words), 0, 0
    for _ in range(300):
        body = [" ".join(r.choice("abcd") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 9))]
        sides = [[[f"{side}{r.randrange(9)}" for _ in range(r.randrange(4))] for side in "xy"] for _ in range(2)]
        if sum(len(x.split()) for x in body) < words:
            continue
        picked = []
        for before, after in sides:
            lines, weights = weighed("\n".join([*before, *body, *after]), words)
            hashes, start = [hash(x) % 97 for x in lines], len(before)
            chosen = {minimum(hashes, w): w for w in windows(weights, words)}
            picked.append({minimum(hashes, w) - start for w in windows(weights, words) if start <= w[0] and w[1] <= start + len(body)})
            some, every = some + len(chosen), every + len(lines)
        assert picked[0] == picked[1] and picked[0]
    assert some < 0.85 * every


def test_hot_and_very_long_texts(spark):
    """One line in a third of all texts, and a text of 200,000 lines that holds it too."""
    common = "this line is everywhere in the corpus"
    long = "\n".join([f"own line number {i}" for i in range(200_000)] + [common])
    texts = [f"first {i} of all\n{common}\nlast {i} of all" if i % 3 == 0 else f"only text {i}" for i in range(3000)] + [long, long]
    got = left(spark, texts, 3)
    assert got[0] == texts[0] and got[3] == "first 3 of all\nlast 3 of all" and got[4] == texts[4] and got[-2] == long.rpartition("\n")[0] and got[-1] == ""
