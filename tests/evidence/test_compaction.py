"""Windows along chains against walks of the chains."""

import random

from weft.operators import compaction


def test_windows(spark):
    r = random.Random(6)
    rows = []
    for chain in range(6):
        for step in range(300 if chain == 0 else 20):
            bad = chain in (2, 3) and step == 7 * chain - 9
            for ord_ in range(r.randrange(1, 4)):
                rows.append((chain, step, ord_, "message" if bad or (ord_ and r.random() < 0.4) else r.choice(["compaction", "X.Compact"]), r.choice([None, "", "text", "längerer"]), (step * 7 + chain) % 11 == 0))
    frame = spark.createDataFrame(rows, "chain long, step long, ord long, type string, text string, replaces boolean").repartition(5)
    for mode in ("chain", "independent", "mixed"):
        want, windows = [], {}
        for chain in range(6):
            window, first, ran = [], None, True
            for step in sorted({x[1] for x in rows if x[0] == chain}):
                all_ = sorted(x for x in rows if x[:2] == (chain, step))
                own = [x for x in all_ if "compact" in x[3].lower()]
                ran = ran and bool(own)
                mine = own if ran else []
                if ran and (mode == "chain" or mode == "mixed" and all_[0][5]):
                    window, first = [], step
                window = window + mine
                chars = lambda xs: sum(len(x[4] or "") for x in xs)
                want.append((chain, step, len(all_), len(all_) - len(own), len(mine), chars(mine), len(window) - len(mine), len(window), chars(window), first, ran))
            windows[chain] = window
        made = compaction.steps(frame, mode)
        assert sorted(tuple(x) for x in made.collect()) == want
        got = sorted((x["chain"], x["place"], x["step"], x["ord"]) for x in compaction.window(frame, made).collect())
        assert got == [(c, i, x[1], x[2]) for c in range(6) for i, x in enumerate(windows[c])]
