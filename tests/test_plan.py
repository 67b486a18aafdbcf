"""Reading a plan against plain loops over one request at a time."""

import random

from evidentia.operators import plan


def test_orders_and_lines(spark):
    rng = random.Random(4)
    batches = [(f"b{i}", rng.choice(["Z-1", "z-2", "Z-3", None]), rng.choice(["ЛП1", "L2", "Отложенные"]), rng.choice(["печать", "экструзия"]), rng.randrange(4), rng.choice([None, *range(9)])) for i in range(40)]
    requests = [(i, rng.choice([None, "", " Z-1", "Z-2 ", "Z-9"]), rng.choice([None, "лп1", "l2", "нет"]), rng.choice([None, "Печать", "сушка"])) for i in range(80)]
    low = lambda x: (x or "").strip().lower().replace("l", "л") if x else x
    expected = []
    for req, order, line, stage in requests:
        if (order or "").strip():
            own = sorted((b for b in batches if b[1] and b[1].lower() == order.strip().lower()), key=lambda b: (b[4], b[0]))
            fits = not stage or any(b[3] == stage.lower() for b in own)
            if not own or not fits:
                expected.append((req, "order: no such stage" if own else "order: nothing") + (None,) * 9)
                continue
            for i, b in enumerate(own, 1):
                line_up = [x[0] for x in sorted((x for x in batches if x[2:4] == b[2:4] and x[5] is not None), key=lambda x: (x[5], x[0]))]
                at = line_up.index(b[0]) if b[0] in line_up else None
                side = lambda k: line_up[k] if at is not None and 0 <= k < len(line_up) else None  # noqa: B023, E731
                near = (side(at - 1), side(at + 1), at + 1, len(line_up)) if at is not None else (None,) * 4
                expected.append((req, "order", i, b[0], b[3] == stage.lower() if stage else None, *near, any(x[2] != "Отложенные" for x in own), len(own)))
        elif line:
            own = [b for b in batches if low(b[2]) == low(line) and (not stage or b[3] == stage.lower())]
            found = sorted(own, key=lambda b: (b[5] is None, b[5] or 0, b[0]))[:5]
            expected += [(req, "line", i, b[0]) + (None,) * 6 + (len(own),) for i, b in enumerate(found, 1)] or [(req, "line: nothing") + (None,) * 9]
        else:
            expected.append((req, "input error") + (None,) * 9)
    got = plan.read_plan(
        spark.createDataFrame(requests, "req int, order_no string, line string, stage string"), spark.createDataFrame(batches, "batch string, order_no string, line string, stage string, seq int, started int"), ["Отложенные"], 5
    ).select("req", "way", "rank", "batch", "asked_stage", "previous", "next", "position", "queue_length", "placed", "total")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected))
    assert {e[1] for e in expected} == {"order", "order: nothing", "order: no such stage", "line", "line: nothing", "input error"}
