import pytest

from folio_spark.llm import pairs as P

WORLD = {
    "en": ["The committee approved the budget after a long discussion.", "The water meter was replaced because the figures were incomplete.", "In practice, the schedule covered the storage yard for safety reasons."],
    "de": ["Der Ausschuss genehmigte das Budget nach langer Diskussion.", "Der Wasserzähler wurde ersetzt, weil die Zahlen unvollständig waren.", "Die Richtlinie ergänzte den Plan aus Gründen der Sicherheit."],
    "fr": ["La commission a approuvé le budget après un long débat.", "Le compteur a été remplacé parce que les chiffres étaient incomplets.", "En pratique, le calendrier a complété la réserve de sécurité."],
    "es": ["La comisión aprobó el presupuesto tras un largo debate.", "El contador fue sustituido porque las cifras estaban incompletas.", "En la práctica, el calendario completó la reserva de seguridad."],
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, lang, " ".join(s * 2) + "\n- " + s[0][:-1] + "\n- " + s[1][:-1]) for i, (lang, s) in enumerate([x for x in WORLD.items() for _ in range(10)])]
    rows += [(1000, None, "Unlabelled."), (1001, "xx", "Rare label."), (1002, "en", None)]
    return P.fit(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))


@pytest.mark.parametrize("text", [None, "", "  \n", "​", "N/A", "Answer:", "[no answer]", "null", "...", "—", "Antwort:", "-"])
def test_empty(text):
    assert P.is_empty(text)


@pytest.mark.parametrize("text", ["Yes.", "In 2031", "9,902 units", "Ja."])
def test_short_answers_are_no_defect(model, text):
    assert P.defect(model, "Is a figure given for the ledger, and if so, which?", text) is None


def test_refusals_are_told_from_reports_of_refusals():
    assert all(map(P.is_refusal, ["I'm sorry, but I can't help with this.", "Leider kann ich dazu keine Auskunft geben.", "Je préfère ne pas répondre à cela.", "Debo negarme a comentar este documento."]))
    assert not any(map(P.is_refusal, ["The inspector declined to sign because the ledger.", "Laut Protokoll konnte die Abteilung dabei nicht helfen.", "Users saw “I cannot answer that” twice.", "El inspector se negó a firmar."]))


def test_refusals_stand_anywhere_and_little_else_is_said():
    opening = "Thank you for the question on the maintenance of the northern pump house, which was read here with a good deal of interest and passed on to the people who look after the building and its records; "
    assert len(opening) > 175 and P.is_refusal(opening + "I cannot answer it.")
    assert P.is_refusal("That is a fair question about the ledger and its many old entries. I'm sorry, but I can't help with it.")
    assert not P.is_refusal("I cannot recommend this valve enough. It has run for years.") and not P.is_refusal("Ich kann dieses Ventil nicht genug empfehlen.")
    report = "The valve was opened at nine. The pressure rose by two bar within the hour. The log shows no further alarm. The shift ended at five without any loss. "
    assert not P.is_refusal(report + "I cannot say who signed it.")


def test_copied():
    q = "How does the page describe the storage yard and the water meter?"
    assert P.is_copied(q, q) and P.is_copied(q, "Q: " + q.lower()) and P.is_copied(q, q + " " + q) and P.is_copied(q, "**How does the page describe storage yard and the water meter**")
    assert not P.is_copied(q, f"The question was: “{q}” The page answers it as follows. The budget was approved by the committee after some weeks of debate in June.")


def test_language_unless_translation_is_asked_for(model):
    assert P.defect(model, WORLD["en"][0], WORLD["fr"][1]) == "language"
    assert P.defect(model, "Translate this statement into French: " + WORLD["en"][0], WORLD["fr"][1]) is None
    assert P.defect(model, WORLD["de"][0], WORLD["de"][1]) is None


def test_truncated(model):
    assert P.defect(model, WORLD["en"][0], WORLD["en"][1] + " The committee approved the") == "truncated"
    assert P.defect(model, WORLD["en"][0], "- " + WORLD["en"][1] + "\n- The committee appr") == "truncated"
    assert P.defect(model, WORLD["en"][0], WORLD["en"][1]) is None


def test_operator_with_odd_records(spark, model):
    m = "messages array<struct<role: string, content: string>>"
    rows = [(1, [("user", "Why?"), ("assistant", None)], 1), (2, None, 1), (3, [], 1), (4, [("assistant", "")], 1), (4, [("assistant", "")], 1), (5, [("user", None), ("assistant", WORLD["en"][0])], 1), (None, [("assistant", "N/A")], 1)]
    got = sorted(P.broken_pairs(spark.createDataFrame(rows, f"pair_id bigint, {m}, defect int"), model).collect(), key=str)
    assert [(r.pair_id, r.defect) for r in got] == sorted([(1, "empty"), (4, "empty"), (4, "empty"), (None, "empty")], key=lambda x: f"Row(pair_id={x[0]}")
    assert P.broken_pairs(spark.createDataFrame([], f"pair_id bigint, {m}"), model).count() == 0


def test_held_out_language_accuracy(model):
    held = {"en": "The delivery window was postponed by the service desk.", "de": "Die Abteilung bestätigte das Protokoll der Sitzung.", "fr": "Le service des archives a publié la liste des contrats.", "es": "El taller de la obra aplazó la entrega de los contratos."}
    assert all(max((p := model.posteriors(t)), key=p.get) == lang for lang, t in held.items())


def test_all_labelled_documents_are_counted(spark):
    """2,000 documents, the language of which only 30 are in, with endings of its own; more than 1,500 and no sample can count exactly."""
    rows = [(i, "en" if i % 67 else "fr", WORLD["en" if i % 67 else "fr"][i % 3] + f"\n- entry of the list of number {i}") for i in range(1, 2001)]
    model = P.fit(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    assert model.langs == ["en", "fr"]
    assert model.tails["prose"][-1] == model.tails["item"][-1] == 2000
    per_doc = sum(len(text) - 11 for _, _, full in rows for text in full.split("\n"))
    assert model.tails["inside"][-1] == per_doc
    for k in range(3):
        ending = [model.tails["prose"][at] for at in P.tail_slots(WORLD["fr"][k])][-1]
        assert ending == sum(t.startswith(WORLD["fr"][k]) for _, _, t in rows)


def test_counts_are_those_of_each_text_by_itself():
    texts = ["The İstanbul report of 2031 ended with  a table.   It was read twice by the committee!", "Short.", "- a list item without a mark at 12\n- Élan vital of the water meters", "", "x" * 25 + "?"]
    got, want = P.TailCounts(), {k: {} for k in ("prose", "item", "inside")}
    got.add(texts)
    for t in texts:
        for kind, a, b in P.endings(t):
            for k, piece in [(kind, t[a:b]), *(("inside", t[a : a + stop].rstrip()) for stop in range(8, b - a - 3))]:
                for at in [*P.tail_slots(piece), P.TAIL_SLOTS - 1]:
                    want[k][at] = want[k].get(at, 0) + 1
    for k, counts in got.counts.items():
        assert {int(at): int(counts[at]) for at in counts.nonzero()[0]} == want[k]
    plain = [P.letters(t) for t in texts]
    assert sorted(P.gram_slots(plain)) == sorted(x for t in plain for x in P.gram_slots([t]))
