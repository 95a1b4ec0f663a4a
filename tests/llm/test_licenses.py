import random
import re

from bitdex.llm import licenses


def brute(text, rules=licenses.RULES):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line = " " + " ".join(words) + " "
    found = []
    for r in rules:
        for m in re.finditer(f" (?:{r.pattern})(?= )", line):
            s = line[:m.start()].count(" ")
            found.append((s, s + m[0].count(" "), r.label, r.priority, r.base))
    kept = [d for d in found if not any(
        (o[3], o[1] - o[0]) > (d[3], d[1] - d[0]) and o[0] <= d[0] and o[1] >= d[1] for o in found)]
    base = [d for d in found if d[4]]
    return (len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
            ",".join(sorted({d[2] for d in base})), ",".join(sorted({d[2] for d in base + kept})),
            max((d[3] for d in kept), default=0) / 100)


def got(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    out = licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return [tuple(r)[1:8] for r in sorted(out)]


CASES = [
    None, "", " \n", "nothing here", "MIT License", "the MIT license, mit-license and MIT\nLicense!",
    "Licensed under the Apache License, Version 2.0.", "GNU General Public License v3.0 or later",
    "GNU General Public License version 2 of the License, or (at your option) any later version",
    "This is free software under the GNU Lesser General Public License version 2.1 only",
    "CC BY 4.0, CC-BY-SA 3.0 Unported and creative commons attribution noncommercial 4.0 international license",
    "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: weird", "apache  é license apache license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy ... mit license",
    "cc by cc by cc by", "mit license " * 300, "dedicated to the public domain; cc0 1.0 universal", "amit license mit licenses",
    "Redistribution and use in source and binary forms, with or without modification, are permitted (BSD 3-Clause)",
]


def test_against_python(spark):
    assert len(licenses.RULES) > 200
    assert got(spark, CASES) == [brute(t) for t in CASES]


def test_suppression(spark):
    [r] = got(spark, ["licensed under the apache license version 2 0"])
    assert r[4] == "apache" and r[5] == "apache,apache-2.0"
    [r] = got(spark, ["gnu lesser general public license v2.1"])
    assert r[4] == "" and r[5] == "lgpl-2.1"


def test_documents(spark, sf001):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    for r in licenses.op4_licenses(spark, sf001).collect():
        assert tuple(r)[1:8] == brute(texts[r.doc_id])


def test_long_null_repeated_and_extra_columns(spark):
    long = "filler words " * 40000 + "mit license" + " more" * 10
    df = spark.createDataFrame([(1, long, "k", 1), (None, "mit license", "k", 2), (1, None, None, 3), (1, None, None, 3)],
                               "doc_id long, text string, _words string, kept int")
    out = sorted((tuple(r) for r in licenses.report(df).collect()), key=str)
    assert len(out) == 4 and [r for r in out if r[0] is None][0][2] == 1
    assert [r for r in out if r[1] > 80000][0][3] == 80000
    assert licenses.report(df.limit(0)).collect() == []


def sample(parsed, rnd):
    """A text that the parsed pattern matches (lookaheads aside)."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            out += "x" if str(arg[0][0]) == "NEGATE" else chr(rnd.choice(arg)[1])
        elif op == "NOT_LITERAL":
            out += "x"
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, part = arg
            out += "".join(sample(part, rnd) for _ in range(rnd.randint(low, min(high, low + 1))))
        elif op == "SUBPATTERN":
            out += sample(arg[3], rnd)
        elif op == "BRANCH":
            out += sample(rnd.choice(arg[1]), rnd)
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_gates_are_necessary(spark):
    """Texts made of every rule's alternatives get what the rules find without gates."""
    rnd = random.Random(6)
    texts = ["FreeBSD License", "Open Font License", "PNG Reference Library License", "general public license version 3",
             "MPLv2", "EPLv2", "CDDLv1", "EUPLv1", "GPL3", "LGPL2.1", "AGPL3 only", "apache2", "CeCILLv2.1", "gplversion 2"]
    assert all(brute(t)[5] for t in texts)
    texts += sorted({sample(re._parser.parse(r.pattern), rnd) for r in licenses.RULES for _ in range(12)})
    assert got(spark, texts) == [brute(t) for t in texts]
    names = {g[:-1] for r in licenses.RULES for g in r.gates if g.endswith("*")}
    assert not [(a, b) for a in names for b in names if a != b and a.startswith(b)]
