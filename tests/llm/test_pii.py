import pytest

from tallyforge.llm import pii
from tallyforge.llm.pii_grammar import WORLD_FAMILY, WORLD_GIVEN, labelled
from tests.llm import pii_sentences

GIVEN = ["Talmo", "Brisa", "Helvus", "Jorlan", "Sage", "Merit", "Quinel", "Derri", "Pelsan", "Vatra", "Norlo", "Kelsis"]
FAMILY = ["Doraberg", "Felwick", "Hanosen", "Kilmann", "Stone", "Bradahl", "Vorberg", "Lunwick", "Talsen", "Gramann", "Ostedahl", "March"]


@pytest.fixture(scope="module")
def tagger():
    names = pii.Gazetteer(GIVEN, FAMILY, pii.usual_words())
    return pii.Tagger(names, pii.train(labelled(GIVEN, FAMILY, 16000, 1), names))


def found(tagger, text):
    return {(k, text[a:b]) for a, b, k in tagger.items(text)}


def test_held_out_accuracy(tagger):
    hit = wrong = missed = 0
    for text, gold in labelled(GIVEN, FAMILY, 800, 77):
        got = set(tagger.items(text))
        hit, wrong, missed = hit + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hit / (hit + wrong) > 0.96 and hit / (hit + missed) > 0.94


def test_unseen_names_in_sentences_kept_apart(tagger):
    """Names that no table and no rule of the grammar holds, in sentences of another hand."""
    cases = pii_sentences.labelled() + pii_sentences.labelled(pii_sentences.PLAIN)
    held = {w for text, gold in cases for a, b, _ in gold for w in text[a:b].split()}
    assert len(held & {*GIVEN, *FAMILY, *WORLD_GIVEN, *WORLD_FAMILY}) == 0
    hit = wrong = missed = 0
    for text, gold in cases:
        got = set(tagger.items(text))
        hit, wrong, missed = hit + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hit / (hit + missed) >= 0.88 and hit / (hit + wrong) >= 0.9


def test_nothing_is_cut_by_length(tagger):
    local, host = "a" * 90, ".".join(["sub"] * 12)
    text = f"Write to {local}@{host}.example.com now. Item {'9' * 60} is here."
    assert found(tagger, text) == {("email", f"{local}@{host}.example.com")}


def test_more_known_names_than_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_NAMES", 3)
    known = spark.createDataFrame([("given", g) for g in GIVEN[:4]], "name_part string, name_text string")
    with pytest.raises(ValueError, match="known names"):
        pii.fit(known, sentences=10)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to talmo.felwick+x@mail.varo.example.org and wait.", {("email", "talmo.felwick+x@mail.varo.example.org")}),
        ("cc brisa [at] varo [dot] example [dot] org, please.", {("email", "brisa [at] varo [dot] example [dot] org")}),
        ("My direct line is (527) 555-0138. Fine.", {("phone", "(527) 555-0138")}),
        ("Tel. +44 7700 900706 ext. 22 works best.", {("phone", "+44 7700 900706")}),
        ("Talmo Felwick (+210 (36) 907-221) can open the gate.", {("name", "Talmo Felwick"), ("phone", "+210 (36) 907-221")}),
        ("The contractor gave SSN 956 30 0554 by mistake.", {("id_number", "956 30 0554")}),
        ("Please delete driving licence (ABCD123456E) from the sheet.", {("id_number", "ABCD123456E")}),
        ("Send the signed copy to 1599 Delka Blvd., Pranat.", {("address", "1599 Delka Blvd.")}),
        ("The office moved to 98, rue de Xasen, Hyka, last month.", {("address", "98, rue de Xasen")}),
        ("Dr. Helvus van der Hanosen reviewed the brief.", {("name", "Helvus van der Hanosen")}),
        ("Brisa Kilmann said the brief was fine; Brisa's own count differs.", {("name", "Brisa Kilmann"), ("name", "Brisa")}),
        ("Hello Talmo,\n\nOne thing.", {("name", "Talmo")}),
        ("Ticket 666-71-9529 was closed. SKU 244-54-2911 replaces it. Run id 3022892021 finished in 3839 ms.", set()),
        ("Node 10.59.0.25 timed out. Pin mernis@latest in the lock file. The asset banner_x@2x.png is missing.", set()),
        ("Hello Vorna team, we rank 57 in Zelniz Street Index polls. Training on Talmo ends in March.", set()),
        ("The merit of the sage harbor is plain. Firms like Talmo Studio agree.", set()),
    ],
)
def test_cases(tagger, text, want):
    assert found(tagger, text) == want


def test_placeholders_leave_the_rest(tagger):
    text = "Hi Talmo,\n\nwrite to brisa@varo.test  now.\n"
    assert tagger.redact(text) == "Hi [NAME],\n\nwrite to [EMAIL]  now.\n"
    assert tagger.redact(None) is None and tagger.redact("") == ""


def test_segments_never_overlap_and_the_best_set_wins():
    spans = [(0, 5, "a", []), (4, 9, "b", []), (9, 12, "c", []), (0, 12, "d", []), (0, 5, "e", [])]
    score = {0: 2.0, 1: 1.5, 2: 1.0, 3: 2.9, 4: -1.0}
    assert [s[2] for s in pii.best(spans, score.get)] == ["a", "c"]
    probs = pii._marginals(spans, [score[i] for i in range(5)])
    assert all(0 <= p <= 1 for p in probs) and probs[0] > probs[4]


def test_frames(spark):
    rows = [(1, "Hello Talmo,\n\nHello Talmo,", "c"), (2, None, "c"), (3, "", "c"), (4, "x" * 30000 + " Dr. Talmo Felwick reviewed it.", "c"), (1, "Hello Talmo,\n\nHello Talmo,", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, surface string")
    known = spark.createDataFrame([("given", g) for g in GIVEN] + [("family", f) for f in FAMILY] + [("given", None)], "name_part string, name_text string")
    got = sorted((r.id, r.pii_kind, r.surface) for r in pii.find(df, "text", "doc_id", known, sentences=2500).collect())
    assert got == [(1, "name", "Talmo"), (1, "name", "Talmo"), (4, "name", "Talmo Felwick")]
    red = pii.redact(df, "text", "doc_id", known, sentences=2500).collect()
    assert len(red) == 5 and {r.text for r in red if r.id == 1} == {"Hello [NAME],\n\nHello [NAME],"}
    assert pii.find(df.limit(0), "text", "doc_id", known, sentences=200).count() == 0
    assert pii.find(df, "text", "doc_id", known.limit(0), sentences=200).count() >= 0
