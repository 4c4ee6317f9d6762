import pytest

from corpusmith.llm import quality_rules as Q

from ..compare import assert_same, save
from .fixtures import awkward, clashing, documents, empty


def bits(spark, text, terms=Q.INSULTS):
    row = Q.ledger(documents(spark, [text]), terms).first()
    return {n for n, b in Q.BIT.items() if row.fail_bits & b}


PROSE = " ".join(f"word{i} the of" for i in range(40))


@pytest.mark.parametrize(
    ("text", "fails"),
    [
        (PROSE, set()),
        ("", {"empty"}),
        (None, {"empty"}),
        ("short text", {"short"}),
        (PROSE.upper(), {"shouting"}),
        (PROSE.replace(" ", "# "), {"symbols"}),
        (PROSE.replace(" ", " | "), {"bars"}),
        ("same " * 80, {"repeated_words"}),
        ("\n".join([PROSE] * 5), {"repeated_lines"}),
        (PROSE + " Lorem ipsum dolor", {"placeholder"}),
        (PROSE + " you idiot, you Moron!", {"abuse"}),
        (PROSE + " one idiot", set()),
        (" ".join(str(i * 7919) for i in range(60)), {"no_letters"}),
    ],
)
def test_rules(spark, text, fails):
    got = bits(spark, text)
    assert fails <= got and bool(fails) == bool(got)


def test_policies_come_from_the_ledger_alone(spark):
    table = Q.ledger(documents(spark, [PROSE, "short text", "same " * 80, ""]))
    rows = Q.apply_policies(table.select("doc_id", "fail_bits")).orderBy("doc_id").collect()
    assert [(r.keep_v1, r.keep_v2) for r in rows] == [(True, True), (False, True), (False, False), (False, False)]
    got = {(r.policy, r.rule): (r.n_fail, r.n_only, r.n_kept, r.n_kept_without) for r in Q.ablation(table).collect()}
    assert got["v1", "short"] == (1, 1, 1, 2) and got["v2", "repeated_words"] == (1, 1, 2, 3) and got["v1", "bars"] == (0, 0, 1, 1)


def test_learned_terms(spark):
    texts = [f"plain words{i} {'blorgo' if i < 12 else 'fine'} rare{i}" for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i < 12)) for i in range(60)] + [(None, 1, 1), (999, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [*texts, None])
    assert Q.toxic_terms(docs, labels) == ["blorgo"]
    assert Q.toxic_terms(empty(spark), labels) == Q.toxic_terms(docs, labels.where("false")) == []


def test_awkward_rows(spark, tmp_path):
    for docs in (awkward(spark), clashing(awkward(spark)), empty(spark)):
        table = Q.ledger(docs)
        assert table.count() == docs.count()
        kept = Q.keep(docs)
        assert kept.columns == docs.columns
        assert kept.count() == Q.apply_policies(table).where("keep_v2").count()
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    save(spark, tmp_path, documents=awkward(spark), labels=labels)
    assert_same(Q.apply_policies(Q.ledger(awkward(spark))), tmp_path, Q.policies_sql())


@pytest.mark.parametrize("n", [1100, 1300, 5000])
def test_distinct_words_have_no_cut(spark, n):
    """On both sides of 1,200 words: some more distinct words than the bound pass, some fewer fail."""
    bound = min(n / 5, (48 * n) ** 0.5)
    for kinds, fails in ((int(bound * 0.95), True), (int(bound * 1.05), False)):
        text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in (k % kinds for k in range(n)))
        assert ("repeated_words" in bits(spark, text)) == fails


def test_long_texts_pass(spark):
    a = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a[i // 17576 % 26] + a[i // 676 % 26] + a[i // 26 % 26] + a[i % 26] for i in range(1_000_100))
    assert bits(spark, text) == set() and Q.keep(documents(spark, [text])).count() == 1


@pytest.mark.parametrize("n", [58, 61, 100])
def test_abuse_is_a_rate(spark, n):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)]
    assert ("abuse" in bits(spark, " ".join(["idiot", *words[1:]]))) == (n < 60)
    assert "abuse" in bits(spark, " ".join(["idiot", "moron", *words[2:]]))


def test_policies_read_what_is_stored(spark):
    docs = documents(spark, [PROSE, "same " * 80, "short text"])
    stored = Q.stored_rows(docs)
    assert {r.doc_id for r in Q.kept_rows(stored).collect()} == {r.doc_id for r in Q.keep(docs).collect()}
    assert {r.n_kept for r in Q.ablation(stored).where("policy = 'v2'").collect()} == {2}
    assert Q.kept_rows(stored, "v1").count() == 1 and Q.kept_rows(stored).columns == docs.columns
