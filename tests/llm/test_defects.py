import random

import pytest

from tallyforge.llm import defects as d
from tallyforge.session import Scratch

PROMPT = "Judge the reply drafted for Nova Studio. The brief says that Elm opened 40 frontend roles. Return a verdict and one reason."
GERMAN = "Bewerten Sie die Antwort an Nova Systems. Das Signal nennt 23 offene Stellen bei Elm. Geben Sie ein Urteil mit Begründung."
GOOD = [
    "PASS", "fail.", "Yes", "3/5", '{"verdict": "FAIL", "reason": "The text cannot support the figure of 527."}', "The verdict is PASS because the writer declines to quote a rate before the scope is known.",
    'The mail quotes "Der Ton ist höflich und die Frage am Ende bleibt offen." and explains it in English. Verdict: FAIL', "- verdict: PASS\n- reason: the wording stays neutral, and the prospect can decline\n- score: 3/5",
    'You wrote "Judge the reply drafted for Nova Studio." My view: the claim rests on a single weak source and is stated as fact.', "Hello,\n\nWe cannot promise the full team, but a partial start is realistic.\n\nBest,\nThe delivery desk",
    "I'm sorry that the rollout slipped; two of our people know that setup well.", "We can start in May.\n\n- option one: start in November\n- option two: wait", '] {"verdict": "PASS", "reason": "It holds."}',
]
EMPTY = [None, "", " \n\t", "null", "None", "n.a.", "...", "{}", "[]", '""', "```\n```", "- \n- \n- ", "Verdict:\nReason:", '{"verdict": "", "reason": ""}', "Hello,\n\n\n\nBest,", "<no output>", "(blank)", "​", "] "]
REFUSALS = ["I can't help with that request.", "No rating will come from me.", "Unfortunately, the review is not one I can provide.", "My answer to this verdict has to be no under the policy I follow.", '{"verdict": null, "reason": "I must decline to produce this email."}', "Apologies, but that content is off limits for me."]
TRUNCATED = ["The verdict is FAIL becau", '{"verdict": "FAIL", "reason": "The text', "Two remarks follow.\n1. The text holds.\n2.", "The text holds. The staff-", "It is so (see", "| a | b |\n| c | d |\n| e |", '```json\n{"verdict": "FAIL",', 'The draft says "If you like, we start.', "FAIL\n\nReason: It holds.\nNote: A shorter", "We list. Three options remain:", 'The mail quotes "Leider passt der Termin nicht, wir melden uns']
COPIES = [PROMPT, "Sure! " + PROMPT, "> " + PROMPT.replace(". ", ".\n> "), PROMPT.lower(), PROMPT[30:], PROMPT.replace("drafted", "drfated").replace("frontend", "fronntend"), '{"verdict": "PASS", "reason": "' + PROMPT + '"}', PROMPT + "\n\nAnswer:", PROMPT[:90]]
FOREIGN = [(PROMPT, "Der Ton ist höflich und die Frage am Ende bleibt offen."), (PROMPT, "範囲が明確になれば開始できます。"), (PROMPT, "De toon is rustig, maar de vraag aan het eind ontbreekt."), (GERMAN, "The wording stays neutral, and the prospect can decline without effort.")]


def run(spark, rows):
    df = spark.createDataFrame([("trace", i, p, r, "clash") for i, (p, r) in rows], "record_kind string, record_id long, prompt string, response string, defect string")
    return {r.record_id: r.defect for r in d.defects(df).collect()}


@pytest.mark.parametrize(("kind", "cases"), [(None, [(PROMPT, x) for x in GOOD] + [(GERMAN, "Der Ton ist höflich und die Frage bleibt offen.")]), ("empty", [(PROMPT, x) for x in EMPTY]), ("refusal", [(PROMPT, x) for x in REFUSALS] + [(GERMAN, REFUSALS[0])]), ("truncated", [(PROMPT, x) for x in TRUNCATED]), ("copied_prompt", [(PROMPT, x) for x in COPIES]), ("other_language", FOREIGN)])
def test_kinds(spark, kind, cases):
    got = run(spark, list(enumerate(cases)))
    wrong = [(cases[i][1], got.get(i)) for i in range(len(cases)) if got.get(i) != kind]
    assert not wrong


def test_clusters_carry_refusals_to_near_openings(spark):
    template = "After careful thought about everything you sent over to me this week I will not go ahead with the {} of the draft today."
    rows = [(i, (f"Prompt {w} one.", template.format(w))) for i, w in enumerate(["rating", "review", "check", "rating"])]
    assert set(run(spark, rows).values()) == {"refusal"}
    long = "now " + " ".join(f"word{i}" for i in range(40))
    rows = [(1, ("Please rate it.", f"I cannot help with this {long}.")), (2, ("Quite another thing.", f"I cannot help with this {long}.")), (3, ("Third.", f"Nobody could ever do this {long}.")), (4, ("Fourth.", "After careful thought about everything you sent over to me this week the list went to the printer."))]
    got = run(spark, rows)
    assert got == {1: "refusal", 2: "refusal", 3: "refusal"}


def test_clusters_are_whole_components_of_all_near_openings(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(24)) for _ in range(12)]
    texts = set(base)
    for b in base:  # chains: each changes another end of the one before
        for k in range(6):
            w = b.split(" ")
            w[k % 2 * -1] = f"x{rng.randrange(9)}"
            b = " ".join(w[:-1] if k % 3 == 2 else w)
            texts.add(b)
    found = spark.createDataFrame([(i, [x]) for i, x in enumerate(sorted(texts))], "kind long, openings array<string>")
    of = {r.opening: r.cluster for r in d.clusters(found, Scratch(spark, "clusters")).collect()}
    root, grams = {x: x for x in texts}, {x: d.shingles(x) for x in texts}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in texts:
        for b in texts:
            if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                root[top(a)] = top(b)
    want = {frozenset(x for x in texts if top(x) == t) for t in map(top, texts)}
    assert {frozenset(x for x in texts if of[x] == c) for c in of.values()} == want and len(want) < len(texts)


def test_a_refusal_reaches_openings_that_are_near_it_only_by_a_chain(spark):
    w = [f"word{i}" for i in range(50)]
    first, declining, last = " ".join(["Any", *w[:46]]), " ".join(["I cannot help", *w]), " ".join(["People", *w[4:]])
    texts = [declining, declining, declining, first, last]
    near = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    x, y, z = (d.shingles(d.openings(s)[0]) for s in (first, declining, last))
    assert near(x, y) and near(y, z) and not near(x, z)
    assert run(spark, [(i, (f"Prompt of {'abcde'[i]} here.", s + ".")) for i, s in enumerate(texts)]) == dict.fromkeys(range(5), "refusal")


SPOKEN = {
    "Bewerten Sie die Antwort und nennen Sie die Begründung, die für das Urteil wichtig ist.": (["Leider kann ich bei dieser Anfrage nicht helfen.", "Ich muss diese Bitte ablehnen."], "Wir können nicht das ganze Team zusagen, aber ein Teil ist frei."),
    "Évaluez la réponse et donnez une raison pour le verdict que vous avez choisi.": (["Je ne peux pas vous aider avec cette demande.", "Je dois refuser cette tâche."], "Je préfère ne pas avoir d'appel pour le moment."),
    "Evalúe la respuesta y dé una razón para el veredicto que usted ha elegido.": (["Lo siento, no puedo ayudarle con esta solicitud.", "Debo rechazar esta petición."], "Prefiero seguir por correo y no tener una reunión todavía."),
}


def test_refusals_in_the_languages_of_the_prompts(spark):
    rows, want = [], {}
    for prompt, (refusals, good) in SPOKEN.items():
        for text in (*refusals, good):
            want |= {len(rows): "refusal"} if text != good else {}
            rows.append((len(rows), (prompt, text)))
    assert run(spark, rows) == want


UNSEEN = ["That falls outside what I was set up for.", "I will have to sit this one out, I fear.", "Nothing of the sort will be written by me.", "I'm not the one who may weigh in on such matters.", "You will get no opinion on that out of me."]
ASKED = ["Write a mail to the new client about parking.", "Which of the two plans is cheaper, and why?", "Sum up the minutes of the last board meeting.", "Translate the notice for the visitors.", "Grade the essay on rivers with a mark and a reason.", "Tell me how long the bread has to rest."]
ANSWERS = ["The new client may park behind the mill.", "The second plan is cheaper, as it has no fee.", "The board spoke about the roof and the fees.", "Visitors are asked to wait at the gate.", "The essay gets a good mark, since its facts hold.", "The bread has to rest for an hour."]


def test_templates_that_no_training_sentence_holds_are_found_by_their_recurrence(spark):
    from tallyforge.llm.refusals import PARTS, PLAIN

    said = " ".join([*PLAIN, *(v for p in PARTS.values() for v in p.values())]).lower()
    assert not any(u.lower().rstrip(".") in said for u in UNSEEN)
    rows, want = [], {}
    for k in range(10):
        for ask, answer in zip(ASKED, ANSWERS, strict=True):
            rows.append((len(rows), (f"{ask} Case {k}.", answer)))
            want[len(rows)] = "refusal"
            rows.append((len(rows), (f"{ask} Note {k}.", UNSEEN[(k + ASKED.index(ask)) % 5])))
    assert run(spark, rows) == want


def test_recurrence_counts_for_unrelated_prompts_and_against_one_kind(spark):
    said = spark.createDataFrame([("all", k % 8) for k in range(40)] + [("some", k % 2) for k in range(40)] + [("once", 3)], "cluster string, kind long")
    kinds = spark.createDataFrame([(k, 0.125) for k in range(8)], "kind long, share double")
    got = {r.cluster: r.recurs for r in d.recurrence(said, kinds).collect()}
    assert got["all"] > 3 and got["some"] < -8 and abs(got["once"]) < 1e-6


def test_late_and_long_sentences_count_whole(spark):
    late = "Re: our talk. Hello there. We read it. The plan is clear. It was sent today. I can't help with that request."
    long = "this note says again that " + " ".join(f"word{i}" for i in range(60))
    rows = [(1, ("One prompt.", late)), (2, ("Other prompt.", f"{long} and I cannot help with that.")), (3, ("Third prompt.", f"{long} " + " ".join(f"more{i}" for i in range(30)) + "."))]
    assert run(spark, rows) == {1: "refusal", 2: "refusal"}


def test_repeats_nulls_and_long_texts(spark):
    rows = [(1, (None, "Fine.")), (1, (None, "Fine.")), (2, (None, None)), (3, ("", "x " * 20000)), (None, (PROMPT, None)), (4, (PROMPT, "The text holds. " * 3000))]
    got = run(spark, rows)
    assert got == {2: "empty", 3: "truncated"}
    assert run(spark, []) == {}
    assert d.defect_report(spark.createDataFrame([("trace", 1, "empty")], "record_kind string, record_id long, defect string")).count() == 1
