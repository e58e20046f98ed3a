"""Validation scores every text of the held-out hosts, by the rule that the operator uses."""

from pyspark.sql import functions as F

from meshwright.llm import residue


def test_every_text_is_scored(spark):
    rows = [(k, f"host {k % 4}", f"The valve {k} closes the bore. " + ("404 Not Found." if k % 5 == 0 else "It is round.")) for k in range(40)]
    rows += [(100, "host 1", "The shaft turns in its bearing. " * 1200 + "Access denied."), (101, "host 2", None), (102, "host 3", "")]
    docs = spark.createDataFrame(rows, "id long, text_host string, text string").withColumnRenamed("text_host", "host")
    got = residue.validate(docs, "id", "text", "host", folds=2, n=10)
    assert sum(r["texts"] for r in got) == 41 and sum(r["residue_texts"] for r in got) == 9
    # the same decisions as the operator's, fold by fold, with the same models
    kept = docs.select(F.col("id"), F.pmod(F.xxhash64("host"), F.lit(2)).alias("fold"), residue.plain_spaces(F.col("text")).alias("t")).filter("t <> ''").orderBy("id").collect()
    share = int(10 / 43 * 1_000_000)
    drawn = {r[0] for r in docs.filter((F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < share) & (F.length("text") <= residue.TRAIN_CHARS)).select("id").collect()}
    for r in got:
        model = residue.train([x["t"] for x in kept if x["id"] in drawn and x["fold"] != r["fold"]])
        held = [x["t"] for x in kept if x["fold"] == r["fold"]]
        found = residue.flags(model, *residue._buffer(held))
        true = [("404" in t or "denied" in t) for t in held]
        both = sum(bool(f) and t for f, t in zip(found, true))
        assert r["text_recall"] == both / sum(true) and (r["text_precision"] == both / found.sum() if found.any() else r["text_precision"] is None)


def test_hints_let_every_notice_through():
    units = ["Seite wurde nicht gefunden.", "The requested document could not be opened.", "Skripte sind ausgeschaltet.", "Test paragraph.", "500 Internal Server.", "test, test, test, test", "sed do eiusmod tempor incididunt ut labore et"]
    assert [residue.weak_label(u) for u in units] == [1] * len(units)


def test_the_model_alone_decides(monkeypatch):
    texts = ["A valve 4 closes the bore. " * 3 + x for x in ("404 Not Found", "It is round.", "[insert title]", "ここにダミーテキスト")]
    model = residue.train(texts * 5)
    before = residue.flags(model, *residue._buffer(texts)).tolist()

    def fail(*_):
        raise AssertionError("labels are for training only")

    for name in ("weak_label", "phrase_label", "placeholder", "phrase", "may_label"):
        monkeypatch.setattr(residue, name, fail)
    assert residue.flags(model, *residue._buffer(texts)).tolist() == before == [True, False, True, True]


def test_the_scan_lets_every_label_through():
    lines = residue.seeds() + ["[insert title] is", "x x x x", "A valve 4 closes."]
    may = residue.may_label(lines)
    assert all(m or residue.weak_label(line) == 0 for m, line in zip(may, lines)) and not may[-1]


def test_denied_phrases_are_measured_apart(spark):
    rows = [(k, f"h{k % 6}", f"The valve {k} closes. " + ("404 Not Found." if k % 4 == 0 else "Access denied." if k % 4 == 1 else "It is round.")) for k in range(120)]
    got = residue.validate(spark.createDataFrame(rows, "id long, host string, text string"), "id", "text", "host", folds=2, n=60, labelled=60, new=True)
    assert all(0 <= r["new_texts"] <= r["residue_texts"] for r in got) and sum(r["residue_texts"] for r in got) == 60
