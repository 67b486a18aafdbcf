"""Grounding of conflicts against plain loops over one run at a time."""

import random
import re

from evidentia.operators import containment, evidence, grounding

STEMS = {"диаметр": "диаметр", "кольца": "кольц", "кольцо": "кольц", "калибр": "калибр", "вид": "вид", "печати": "печ", "блок": "блок", "блока": "блок", "год": "год"}


def stems(t):
    return {STEMS[w] for w in (t or "").split()}


def is_known(locator, known):
    """known: (head, row) of a run; a head stands for itself, else the first known one that holds it or is held by it."""
    if locator is None:
        return False
    m = re.match(r"^(.*?)(?:,?\s*rows?\s+(\d.*))?$", locator)
    head, rows = " ".join(m[1].lower().split()), [int(x) for x in re.findall(r"\d+", m[2] or "")]
    heads = sorted({h for h, _ in known})
    like = [head] if head in heads else [h for h in heads if head and (head in h or h in head)]
    return bool(like) and all((like[0], r) in known for r in rows)


def brute(conflicts, omissions, places, links, known, questions):
    out = []
    for run in {c[0] for c in conflicts} | {o[0] for o in omissions}:
        own = {(h, r) for k, h, r in known if k == run}
        mine = sorted((o[1], o[2], o[3]) for o in omissions if o[0] == run)
        read = [c for _, _, c in sorted(p for p in places if p[0] == run) if is_known(c, own)]

        def shown(o):
            if not is_known(o[2], own) or not read:
                return None
            near = sorted((k, c) for clause, k, c in links if clause == o[2] and c in read)
            return (o[1], o[2], near[0][1] if near else read[0])

        named = set()
        for _, n, subject, a, b in [c for c in conflicts if c[0] == run]:
            first = next((o for o in mine if stems(o[1]) & stems(subject)), None)
            if is_known(a, own) and is_known(b, own):
                row = ("grounded", n, subject, a, b)
            elif first and shown(first):
                row = ("rescued", n, *shown(first))
            else:
                row = ("dropped", n, subject, a, b)
            out.append((run, *row))
            named |= stems(row[2]) if row[0] != "dropped" else set()
        question, checking = next(((q, c) for k, q, c in questions if k == run), (None, None))
        for o in mine:
            if not stems(o[1]) & named and run in {q[0] for q in questions} and (checking or (stems(o[1]) and stems(o[1]) <= stems(question))) and shown(o):
                out.append((run, "found", o[0], *shown(o)))
    return sorted(map(str, out))


def run(spark, conflicts, omissions, places, links, known, questions):
    got = grounding.ground(
        spark.createDataFrame(conflicts, "run int, n long, subject string, expected_source string, actual_source string"), spark.createDataFrame(omissions, "run int, place long, param string, clause string"),
        spark.createDataFrame(places, "run int, code_order int, code string"), spark.createDataFrame(links, "clause string, link_order int, code string"),
        spark.createDataFrame(known, "run int, head string, row long"), spark.createDataFrame(questions, "run int, question string, checking boolean"),
    )
    return sorted(str(tuple(r)) for r in got.select("run", "origin", "n", "subject", "expected_source", "actual_source").collect())


def test_an_omission_takes_the_place_of_what_can_not_be_shown(spark):
    conflicts = [(1, 1, "диаметр кольца", "rules, row 51", "nowhere"), (1, 2, "вид печати", "rules, row 51", "code ring, row 3"), (2, 1, "диаметр", "rules, row 51", None)]
    omissions = [(1, 1, "диаметр кольца", "rules, row 51"), (1, 2, "калибр", "rules, row 51"), (2, 1, "диаметр кольца", "rules, row 51")]
    places = [(1, 1, "code ring, row 3"), (1, 2, "code load, row 7"), (2, 1, "code ring, row 3")]
    links = [("rules, row 51", 20, "code load, row 7"), ("rules, row 51", 1, "code other, row 1")]
    known = [(1, "rules", 51), (1, "code ring", 3), (1, "code load", 7), (2, "code ring", 3)]
    questions = [(1, "почему калибр", False), (2, "диаметр кольца", True)]
    questions[0] = (1, "калибр", False)
    got = run(spark, conflicts, omissions, places, links, known, questions)
    assert got == sorted(map(str, [
        (1, "rescued", 1, "диаметр кольца", "rules, row 51", "code load, row 7"), (1, "grounded", 2, "вид печати", "rules, row 51", "code ring, row 3"),
        (1, "found", 2, "калибр", "rules, row 51", "code load, row 7"), (2, "dropped", 1, "диаметр", "rules, row 51", None),
    ]))


def test_random_runs_against_plain_loops(spark):
    rng = random.Random(1)
    words, heads = list(STEMS), ["rules", "the rules of print", "code ring", "plan"]
    name = lambda: " ".join(rng.sample(words, rng.choice((1, 2))))
    place = lambda: rng.choice([f"{rng.choice(heads)}, row {rng.randrange(4)}", f"Rules, rows {rng.randrange(4)}, {rng.randrange(4)}", "plan", "nowhere", None])
    some = lambda: place() or "plan"
    conflicts = [(r, n, rng.choice([name(), None]), place(), place()) for r in range(80) for n in range(rng.randrange(4))]
    omissions = [(r, n, name(), some()) for r in range(80) for n in range(rng.randrange(4))]
    places = list({(r, c): (r, k, c) for r in range(80) for k in range(3) for c in [some()]}.values())
    links = list({(a, b): (a, k, b) for k in range(40) for a in [some()] for b in [some()]}.values())
    known = [(r, rng.choice(heads[:3]), rng.randrange(4)) for r in range(80) for _ in range(rng.randrange(16))]
    questions = [(r, rng.choice([name(), None]), rng.choice([True, False, None])) for r in range(78)]
    expected = brute(conflicts, omissions, places, links, known, questions)
    assert run(spark, conflicts, omissions, places, links, known, questions) == expected
    assert {e.split("'")[1] for e in expected} == {"grounded", "rescued", "dropped", "found"}


def test_inside_finds_every_pair(spark):
    rng = random.Random(1)
    some = ["".join(rng.choices("abc ", k=rng.randrange(0, 9))) for _ in range(120)]
    few = ["".join(rng.choices("abc ", k=rng.randrange(0, 5))) for _ in range(60)]
    got = containment.inside(spark.createDataFrame([(x,) for x in some], "t string"), "t", spark.createDataFrame([(x,) for x in few], "n string"), "n")
    assert {tuple(r) for r in got.collect()} == {(b, a) for a in some for b in few if a and b and b in a}


def test_empty_tables(spark):
    assert run(spark, [], [], [], [], [], []) == []
    known = spark.createDataFrame([], "run int, head string, row long")
    assert evidence.known_locators(spark.createDataFrame([], "run int, locator string"), known).count() == 0
