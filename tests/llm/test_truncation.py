import random

from pyspark.sql import functions as F

from stratagraph.llm import truncation as t

WORDS = "the plan keeps every row that a reader asked for and the queue drains before the lock is given back to its owner".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 14))).capitalize() + " in the end."


def corpus(n=600, limit=200):
    rng = random.Random(5)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 7)))
        if len(text) > limit and i % 2:
            text = text[:limit]
            if text[-1] == " " or text.rstrip()[-1] == "." or text.endswith("the end"):
                text = text[: limit - 3] + "asq"
            cut.add(i)
        elif i % 41 == 0:
            text = text[: len(text) // 2].rstrip() + "xq"
            cut.add(i)
        rows.append((i, text, "en", "notes" if i % 3 else None))
    return rows, cut


def test_finds_cuts_at_limits_and_elsewhere(spark):
    rows, cut = corpus()
    extra = [(1000, None, "en", "notes"), (1001, "", "en", "notes"), (1002, " \n\t", "en", "notes"), (1003, rows[0][1], None, None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string").withColumn("share", F.lit(1))
    got = {r.doc_id for r in t.judged(df).where("cut").collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.03 * len(got)
    assert not got & {1000, 1001, 1002}


def test_limits(spark):
    rng = random.Random(1)
    lengths = [("a", "chars", rng.randint(50, 900)) for _ in range(3000)] + [("a", "chars", 500)] * 40 + [(None, "chars", 77)] * 30
    got = t.significant_lengths(spark.createDataFrame(lengths, "source string, unit string, length long")).collect()
    assert {(r.source, r.length) for r in got} == {("a", 500), (None, 77)}
    assert t.significant_lengths(spark.createDataFrame([], "source string, unit string, length long")).collect() == []


def test_numbers_and_marks(spark):
    rows, _ = corpus()
    schema = "doc_id long, text string, lang string, source string"

    def listed(seed, last):
        """A text of 200 characters that ends in a list of four-digit numbers and a last one."""
        rng = random.Random(seed)
        text, tail = sentence(rng) + " refs #2876", f" #{last}"
        text += "".join(f" #{rng.randint(1000, 9999)}" for _ in range((200 - len(tail) - len(text)) // 6))
        return "a" * (200 - len(tail) - len(text)) + text + tail

    cut = [(2000 + i, listed(i, "9876"[: 1 + i % 3]), "en", "notes") for i in range(12)]
    marked = [(2100, "Keep every row. refs #4123 #99 [truncated]", "en", "notes")]
    whole = [(2200 + i, f"Keep every {w}. refs #4123 #{1077 + i}", "en", "notes") for i, w in enumerate(WORDS[:8])]
    assert {len(r[1]) for r in cut} == {200}
    got = {r.doc_id: r for r in t.judged(spark.createDataFrame(rows + cut + marked + whole, schema)).where("doc_id >= 2000").collect()}
    assert all(got[r[0]].cut_at_limit and not got[r[0]].cut_in_transfer for r in cut) and got[2100].cut_in_transfer
    assert not any(got[r[0]].cut for r in whole)
    # numbers longer than any inside a text were written to fill the field, and so were the others of that length
    filled = [(2000 + i, listed(i, "10003" if i % 4 == 0 else "9"), "en", "notes") for i in range(12)]
    got = {r.doc_id: r for r in t.judged(spark.createDataFrame(rows + filled, schema)).where("doc_id >= 2000").collect()}
    assert all(r.at_limit and not r.cut for r in got.values())
    assert t.limits_of(spark.createDataFrame([], "source string, text_hash long, unit string, length long")).collect() == []


def test_signatures_are_no_breaks(spark):
    """What ends many texts and nothing else is an author's ending; a verdict doesn't change with the number of other texts."""
    schema = "doc_id long, text string, lang string, source string"
    rng = random.Random(3)
    signed = [(i, f"{sentence(rng)} {sentence(rng)}\nlgtm", "en", "notes") for i in range(9)]
    plain = [(100 + i, f"{sentence(rng)} {sentence(rng)}", "en", "notes") for i in range(60)]
    broken = [(500, sentence(rng) + " The queue drai", "en", "notes"), (501, sentence(rng) + " And the", "en", "notes")]
    for more in (0, 1200):
        others = [(1000 + i, f"{sentence(rng)} {sentence(rng)}", "en", "notes") for i in range(more)]
        got = {r.doc_id for r in t.judged(spark.createDataFrame(signed + plain + broken + others, schema)).where("cut").collect()}
        assert got == {500, 501}


def test_endings_of_long_lines():
    """The words of an ending are those of its whole last sentence or line, however long."""
    long = "w" * 5000
    assert t.ending(1, f"the {long} plan", "en", "a")[5:8] == tuple(t.contexts(["the", long, "plan"]))
    counts = t.Counts()
    counts.add(f"the {long} plan")

    class Everything:
        def __contains__(self, h):
            return True

    assert set(t.contexts(["the", long, "plan"])) <= set(counts.rows(Everything())["h"])
    assert t.opened(["f", "(", "x", ")", '"']) == ["f", "(", "x"] and t.opened([")", ")"]) == [")"]


def test_open_ends():
    assert t.leaves_open("func A() {\n\treturn f(1", "go") and not t.leaves_open("func A() {\n\t// {\n\tx := \"(\"\n}\n", "go")
    assert t.leaves_open("Text\n```sh\nrun", None) and not t.leaves_open("Text\n```sh\nrun\n```", None)
    assert t.leaves_open("Use the `plan", None) and t.leaves_open("def f(a,", "python")


def test_marks():
    assert t.without_mark("half a sen…") == "half a sen" and t.without_mark("half [...]") == "half" and t.without_mark("…") == "…"
    assert t.number_place(["refs", "#", "4123"])[1] == t.number_place(["#", "9"])[1] and t.number_place(["no", "number"]) == (None, None)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert t.judged(df).collect() == [] and t.cut_rates(t.judged(df)).collect() == []


def test_rates(spark):
    rows = spark.createDataFrame([("a", True, True, False), ("a", False, False, False), (None, True, False, True)], "source string, cut boolean, cut_at_limit boolean, cut_in_transfer boolean")
    got = {r.source: (r.texts, r.cut_texts, r.cut_at_limits, r.cut_in_transfer, r.cut_rate) for r in t.cut_rates(rows).collect()}
    assert got == {"a": (2, 1, 1, 0, 0.5), None: (1, 1, 0, 1, 1.0)}
