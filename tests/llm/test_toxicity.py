from graphloom.llm.toxicity import WEIGHTS, clauses, grammar, learned_stems, negation, reported, scored, targeted, threatening, toxicity
from tests.llm.tables import docs, nothing, odd


def apart(text):
    """The transducers one after the other instead of composed."""
    total = 0.0
    for read in clauses(text):
        weight = 0.0
        for t in (negation(), reported(), targeted(WEIGHTS), threatening(WEIGHTS)):
            read, w = t.run(read)
            weight += w
        total += max(weight, 0.0)
    return round(total, 6)


CASES = ["You are an idiot.", "He is not an idiot.", "She said you are an idiot.", "I will kill you!", "I will not hurt you.", "They killed time. What a moron", "Du bist ein Idiot und Abschaum.", "trash day is on Monday", "You idiot", "stupid stupid you; we will burn them all", "nothing here"]


def test_composition_equals_application_in_turn(spark):
    got = {r["doc_id"]: r["score"] for r in toxicity(docs(spark, CASES), all_documents=True).collect()}
    assert got == {i: apart(t) for i, t in enumerate(CASES)}


def test_clauses_not_words():
    machine = grammar()
    score = lambda t: sum(scored(c, machine)[0] for c in clauses(t))
    assert score("You are an idiot.") > score("an idiot") > score("She said you are an idiot.") > 0
    assert score("You are not an idiot.") == 0 and score("I will kill you") > score("kill you") > 0 and score("kill time") == 0


def test_labels(spark):
    """Held against the labelled documents, half of them held out: most toxic ones are found, clean ones left alone."""
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stems = learned_stems(d, labels.where("doc_id % 2 = 0"))
    found = {r["doc_id"] for r in toxicity(d, stems=stems).collect()}
    rows = labels.where("doc_id % 2 = 1").collect()
    bad = {r["doc_id"] for r in rows if r["toxic"] == 1}
    good = {r["doc_id"] for r in rows if r["toxic"] == 0}
    assert len(found & bad) >= 0.9 * len(bad) and len(found & good) <= 0.005 * len(good)


def test_stems(spark):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(8))
    texts = [words(i) + (" grumpfa grumpfo" if i % 4 == 0 else "") for i in range(120)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (5, None), (120, 1)], "doc_id long, toxic int")
    assert learned_stems(docs(spark, texts), labels) == ["grumpf"]
    assert learned_stems(docs(spark, texts), labels.where("doc_id < 12")) == []
    assert learned_stems(nothing(spark), labels) == [] and learned_stems(docs(spark, texts), labels.limit(0)) == []
    got = toxicity(docs(spark, ["a grumpfu and grumpf.", "one grumpfx"]), stems=["grumpf"]).collect()
    assert [(r["doc_id"], r["insults"]) for r in got] == [(0, 2)]


def test_odd_tables(spark):
    rows = toxicity(odd(spark), all_documents=True).collect()
    assert len(rows) == 9 and {r["score"] for r in rows} == {0.0}
    assert toxicity(nothing(spark)).count() == 0
    row = toxicity(docs(spark, ["word " * 200_000 + "you are an idiot and scum."])).first()
    assert row["toxic"] and row["insults"] == 2
