import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import pii

GIVEN, FAMILY = ["Anna", "Jonas", "Maria", "Pavel", "Leila"], ["Kovarik", "Sandell", "Orosco", "Thornby", "Weiland"]


def corpus(n, seed):
    r = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        name = r.choice([f"{r.choice(GIVEN)} {r.choice(FAMILY)}", f"{r.choice(FAMILY)}, {r.choice(GIVEN)}", f"{r.choice('ABC')}. {r.choice(FAMILY)}", f"{r.choice(GIVEN)} {r.choice(FAMILY)}".upper()])
        mail = r.choice(["{}@example.com", "{} (at) mail.example.org", "{}[at]corp[dot]example[dot]net"]).format(r.choice(["a.k", "jonas42", "x_y"]))
        phone = r.choice(["+1 212 555 01{}", "(415) 555-01{}", "0049-30-23125-4{}", "020 7946 01{}"]).format(r.randrange(10, 99))
        number = r.choice([f"{r.randrange(600, 700)}-12-{r.randrange(1000, 9999)}", f"X{r.randrange(10**7, 10**8 - 1)}", f"QQ {r.randrange(10, 99)} 34 56 A"])
        street = r.choice([f"{r.randrange(1, 900)} Mill Gate Road", f"Alte Wehr Straße {r.randrange(1, 200)}", f"Calle del Olmo {r.randrange(1, 99)}"])
        lines = [(f"Contact: {name}, tel {phone}", [("NAME", name), ("PHONE", phone)]), (f"Reach me at {mail} or later.", [("EMAIL", mail)]), (f"The leaked row held SSN {number} in clear.", [("ID_NUMBER", number)]), (f"He lives at {street} and works nights.", [("ADDRESS", street)]), ("See the state section; build 20241234512 on runner 10.4.2.17 at TaskRunner.go", []), ("remote is git@code.example:a/b.git", [])]
        r.shuffle(lines)
        texts.append("\n".join(x for x, _ in lines))
        truth.append({y for _, ys in lines for y in ys})
    return texts, truth


@pytest.fixture(scope="module")
def model():
    return pii.fit(corpus(150, 1)[0])


def test_held_out_accuracy(model):
    texts, truth = corpus(80, 2)
    hit = wrong = total = 0
    for t, want in zip(texts, truth):
        got = {(k, t[a:b]) for a, b, k in pii.find(t, *model)}
        hit, wrong, total = hit + len(got & want), wrong + len(got - want), total + len(want)
    assert hit >= 0.95 * total and wrong <= 0.05 * total


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="Aa9 .,+()-@[]ßÉ\n名²٣", max_size=80))
def test_any_text(text):
    w, lex = pii.fit(["Contact: Anna Kovarik, tel +1 212 555 0101"])
    got = pii.find(text, w, lex)
    assert all(a < b for a, b, _ in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_the_best_of_overlapping_segments_wins(model):
    """The lattice search equals trying every set of segments that do not overlap."""
    import itertools

    w, lex = model
    t = "cc Anna Kovarik, Jonas Sandell, tel 020 7946 0123"
    c = pii.candidates(t)
    score = lambda s: sum(sum(w.get(f, 0.0) for f in pii.features(t, a, b, k, lex)) for a, b, k in s) + sum(w.get(f"{x[2]}+{y[2]}", 0.0) for x, y in zip(s, s[1:]) if y[0] - x[1] <= pii.NEAR)
    sets = [s for n in range(4) for s in itertools.combinations(sorted(c), n) if all(x[1] <= y[0] for x, y in zip(s, s[1:]))]
    assert abs(score(tuple(pii.find(t, w, lex))) - max(map(score, sets))) < 1e-9


@pytest.mark.parametrize("seed", range(12))
def test_transitions_of_either_sign_are_paid(seed):
    """With random weights, many below zero, the set found has the best score of all sets of segments that do not overlap."""
    import itertools

    r = random.Random(seed)
    lex = pii.Lexicon(set(), set(), set())
    t = r.choice(["x Anna Kovarik, Jonas Sandell y", "cc Anna Kovarik, Jonas Sandell, 020 7946 0123", "12 Mill Lane, a.k@example.com, Leila Orosco"])
    c = sorted(pii.candidates(t))
    w = {f: r.uniform(-1, 2) for a, b, k in c for f in pii.features(t, a, b, k, lex)} | {f"{x}+{y}": r.uniform(-9, 2) for x in pii.KINDS for y in pii.KINDS}
    score = lambda s: sum(sum(w.get(f, 0.0) for f in pii.features(t, a, b, k, lex)) for a, b, k in s) + sum(w.get(f"{x[2]}+{y[2]}", 0.0) for x, y in zip(s, s[1:]) if y[0] - x[1] <= pii.NEAR)
    sets = [s for n in range(4) for s in itertools.combinations(c, n) if all(x[1] <= y[0] for x, y in zip(s, s[1:]))]
    assert abs(score(tuple(pii.find(t, w, lex))) - max(map(score, sets))) < 1e-9


def test_accuracy_on_texts_of_other_wording():
    """Sentences that share no wording with those of the fit: shapes and names carry over."""
    r = random.Random(9)
    model = pii.fit([t + r.choice(["\nReported by {} on Tuesday.", "\nDear {} and all,", "\nReviewed by {} (twice) before."]).format(f"{r.choice(GIVEN)} {r.choice(FAMILY)}") for t in corpus(150, 1)[0]])
    hit = wrong = total = 0
    for _ in range(80):
        name, mail, phone, street = f"{r.choice(GIVEN)} {r.choice(FAMILY)}", f"{r.choice(['m.w', 'pav_1'])}@example.org", f"+1 212 555 01{r.randrange(10, 99)}", f"{r.randrange(1, 900)} Mill Gate Road"
        t = f"Yesterday {name} opened the door. Write to {mail} for the key, or dial {phone} after six. The parcel went to {street} on Monday; order 10.4.2.17 stays open."
        want, got = {("NAME", name), ("EMAIL", mail), ("PHONE", phone), ("ADDRESS", street)}, {(k, t[a:b]) for a, b, k in pii.find(t, *model)}
        hit, wrong, total = hit + len(got & want), wrong + len(got - want), total + len(want)
    assert hit >= 0.9 * total and wrong <= 0.1 * total


def test_frames(spark):
    texts, _ = corpus(60, 3)
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(100, None, "x", 0), (101, "", "x", 0), (102, "plain words only", "x", 0), (0, texts[0], "x", 0)], "doc_id bigint, text string, kind string, start int")
    found = pii.found(d)
    assert found.columns == ["doc_id", "kind", "pii_text"] and found.count() == found.distinct().count() > 200
    clean = {r.doc_id: r.clean for r in pii.masked(d).collect()}
    assert clean[100] is None and clean[101] == "" and clean[102] == "plain words only" and "[NAME]" in clean[0]
    assert pii.found(d.limit(0)).count() == 0
