import math
from collections import Counter

import numpy as np

from tarnlake.llm import abuse

FILLER = ["The committee divided on clause {}.", "I thank the member for question {}.", "The harbour levy rose by {} per cent.", "We met the pilots on day {} of the month.", "Nobody disputes the figure of {} crowns."]
BAD = ["You are a stupid {} and always were.", "Shut your mouth, you lying {}!"]


def corpus(n=300):
    rng = np.random.default_rng(1)
    docs, truth = [], set()
    for i in range(n):
        parts = [FILLER[j].format(rng.integers(1000)) for j in rng.integers(len(FILLER), size=6)]
        if i % 9 == 0:
            truth.add(i)
            word = ["toad", "t.o.a.d", "t0ad", "t​oad"][i % 4]
            insult = BAD[i // 18 % 2].format(word)
            parts.insert(3, f"[{insult}]" if i % 4 else insult)
        docs.append((i, " ".join(parts), ["Plenary", "plenary ", "committee"][i % 3]))
    return docs, truth


def test_passages_undo_disguises():
    assert abuse.passages("We met. You t.o.a.d went! <Be a t0ad> the fig-\nures​ rose.") == ["we met.", "you toad went!", "the figures rose.", "be a toad"]
    assert abuse.passages(None) == abuse.passages("") == abuse.passages(" \n") == []


def exact(index, examples, ts, df, documents, k):
    def weigh(x):
        return {t: (1 + math.log(n)) * (math.log((documents + 1) / (df.get(t, 0) + 1)) + 1 if t in index.ids else index.default) for t, n in Counter(x).items()}

    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    q = weigh(ts)
    sims = []
    for e in examples:
        w = weigh(e)
        s = sum(x * q[t] for t, x in w.items() if t in q and t in index.ids) / (norm(q) * norm(w) or 1)
        if s > 0:
            sims.append(s)
    return sorted(sims, reverse=True)[:k]


def test_index_is_exact():
    docs, _ = corpus(120)
    all_terms = [abuse.terms(p) for _, t, _ in docs for p in abuse.passages(t)]
    df = Counter(t for ts in all_terms for t in set(ts))
    examples = {ts: (float(i % 7 == 0), 1.0, 0.0, 0.0, 0.0) for i, ts in enumerate(all_terms)}
    index = abuse.VoteIndex(examples, df, len(docs))
    asked = [*all_terms[:40], abuse.terms("you are a new sort of toad"), abuse.terms("zzz"), (), abuse.terms("toad toad zzz zzz")]
    rows, places, sims = index.nearest(index.weigh(asked), 10)
    likely = index.likely(index.weigh(asked))
    for i, ts in enumerate(asked):
        assert np.allclose(sims[rows == i], exact(index, examples, ts, df, len(docs), 10), atol=1e-5)
        positive = exact(index, [e for e in examples if examples[e][0]], ts, df, len(docs), 1)
        assert likely[i] == bool(positive and positive[0] >= abuse.LEAST)


def test_votes_of_a_batch_are_those_of_each():
    docs, truth = corpus(200)
    texts = {i: [abuse.terms(p) for p in abuse.passages(t)] for i, t, _ in docs}
    df = Counter(t for ps in texts.values() for t in {t for p in ps for t in p})
    readings = {i: [(float(i in truth), float(i in truth), 0.0, 0.0)] for i in texts}
    index = abuse.VoteIndex(abuse.witnesses(texts, readings, df, len(docs)), df, len(docs))
    asked = sorted({p for ps in texts.values() for p in ps})
    votes, evidence = index.vote(asked)
    assert (votes[:, 0] > 0).any() and (votes[:, 2:] == 0).all() and (votes[:, 0] == votes[:, 1]).all()
    for i in range(0, len(asked), 7):
        one, example = index.vote([asked[i]])
        assert np.allclose(one[0], votes[i], atol=1e-9) and example[0] == evidence[i]


def test_held_out_accuracy_and_edges(spark):
    docs, truth = corpus()
    extra = [(1001, None, None), (1002, "", "committee"), (1003, "  ", "committee"), (1004, "The figures rose. " * 20_000 + "You are a stupid toad and always were.", "committee")]
    documents = spark.createDataFrame([(*d, 0.5) for d in docs + extra], "doc_id bigint, text string, source string, score double")
    labels = [(i, a, int(i in truth) ^ int((i + a) % 29 == 0), None if i % 2 else 0, 0) for i in range(0, 300, 2) for a in range(2)]
    labelled = spark.createDataFrame([(i, f"r{a}", x, y, z) for i, a, x, y, z in labels], "doc_id bigint, annotator string, abusive int, hateful int, sexual int")
    scores = abuse.score_documents(documents, labelled).cache()
    found = {r["doc_id"] for r in scores.filter(f"vote >= {abuse.FOUND}").collect()}
    assert 1004 in found and not {1001, 1002, 1003} & found
    held_out = {i for i in range(1, 300, 2)}
    assert len(found & truth & held_out) >= 0.9 * len(truth & held_out)
    assert len((found - truth) & held_out) <= 3
    assert scores.count() == len(docs) + len(extra)
    rates = {r["source"]: r for r in abuse.source_rates(scores).collect()}
    top = scores.filter("doc_id = 1004").first()
    assert top["abusive"] == top["vote"] > top["hateful"] and top["sexual"] == 0 and "toad" in top["passage"]
    assert set(rates) == {"plenary", "committee", None} and rates["plenary"]["documents"] == 200
    none = spark.createDataFrame([], labelled.schema)
    assert abuse.found_documents(documents, none).count() == 0
    assert abuse.found_documents(documents.limit(0), labelled).count() == 0


def word(n):
    return "".join("ba ko du mi ra ze lo nu".split()[n // 8**i % 8] for i in range(4))


def test_every_labelled_document_gives_examples(spark):
    """Insults that one labelled document each has, among more labelled documents than a sample of 8,000 would keep."""
    insults = {i: f"{word(7 * i + 100)} {word(11 * i + 3000)}!" for i in range(80)}
    texts = [(i, f"The committee divided on clause {i}. " + insults.get(i, "")) for i in range(9000)] + [(10_000 + i, f"We met the pilots on day {i}. {x}") for i, x in insults.items()]
    documents = spark.createDataFrame([(i, t, "plenary") for i, t in texts], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, f"r{a}", int(i in insults), 0, 0) for i in range(9000) for a in range(2)], "doc_id bigint, annotator string, abusive int, hateful int, sexual int")
    assert {r["doc_id"] for r in abuse.found_documents(documents, labels).collect()} == {*insults, *(10_000 + i for i in insults)}


def test_parts_of_an_index_vote_as_one(spark, monkeypatch):
    docs, truth = corpus(200)
    docs = [(i, f"{t} Some {word(i % 60)} boats were sold to {word(i % 80 + 900)}.", s) for i, t, s in docs]
    texts = {i: [abuse.terms(p) for p in abuse.passages(t)] for i, t, _ in docs}
    df = Counter(t for ps in texts.values() for t in {t for p in ps for t in p})
    positive = {(i, a): float((i in truth) != ((i + a) % 29 == 0)) for i in texts for a in range(2)}
    readings = {i: [(positive[i, a], positive[i, a], 0.0, 0.0) for a in range(2)] for i in texts}
    index = abuse.VoteIndex(abuse.witnesses(texts, readings, df, len(docs)), df, len(docs))
    expected = {i: max(index.vote(ps)[0][:, 0]) for i, ps in texts.items()}
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, f"r{a}", int(x), 0, 0) for (i, a), x in positive.items()], "doc_id bigint, annotator string, abusive int, hateful int, sexual int")
    for size in (16, abuse.PART):
        monkeypatch.setattr(abuse, "PART", size)
        cut = abuse.cut_documents(documents)
        model = abuse.train(cut, labels)
        assert (len(model.parts) > 5) == (size == 16) and sum(p.examples for p in model.parts) == len(index.texts)
        scores = abuse.score_documents(documents, labels, model).collect()
        assert all(abs(r["vote"] - expected[r["doc_id"]]) < 1e-5 for r in scores) and any(r["vote"] > 0 for r in scores)
    # documents without any vote have the share of positive readings of such documents
    assert all(r["score"] < 0.2 for r in scores if r["vote"] == 0) and any(r["vote"] == 0 for r in scores)
