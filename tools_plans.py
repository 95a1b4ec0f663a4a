"""Write PLANS.md: the formatted physical plans of the headline jobs."""

from __future__ import annotations

import io
import sys
from contextlib import redirect_stdout

sys.path.insert(0, "/root/repo")

from bitdex.operators import index as ix, search as sr, units as un  # noqa: E402
from bitdex.plans import catalog as C                    # noqa: E402
from bitdex.session import local_session                 # noqa: E402


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head, _, rest = text.partition("\n\n(1)")
    details = []
    for block in ("(1)" + rest).split("\n\n"):
        if "Scan parquet" in block.split("\n")[0]:
            keep = [ln for ln in block.split("\n")
                    if ln.startswith(("(", "PushedFilters", "DataFilters", "ReadSchema"))]
            details.append("\n".join(keep))
    return (head.strip() + "\n\n" + "\n\n".join(details)).strip()


def main(sf="/root/testdata/sf0.01"):
    spark = local_session(8)
    out = ["# Physical plans of the headline jobs (sf0.01, local[8], AQE on)", "",
           "Generated by `tools_plans.py`; trees only (`explain('formatted')`).", ""]
    index, params = ix.build_index(C._bodies(spark, sf), C._encoder(), C.K,
                                   projection="pca")
    qk = ix.encode_queries(C._bench_queries(spark, sf), params, C._encoder())
    jobs = {
        "bodies (C1)": C.bodies(spark, sf),
        "index projection (C3: encode + project + pack)": ix._keys(
            C._bodies(spark, sf), "body", C._encoder(), params, "auto", ["id", "title"]),
        "search (C5: scan partial top-k + window merge + title join)":
            sr.resolve_hits(sr.knn(index, qk, params.k, 5), index, params.k),
        "stats (C6: scan partial histogram + grouped merge)":
            sr.distance_histogram(index, qk, params.k),
        "table-form scoring (J1: one scan, one encoder pass)": un.extraction_worklist(C._corpus(spark, sf)),
        "text units (P6)": C.text_units(spark, sf),
        "token profile (F9)": C.token_profile(spark, sf),
        "word pieces (F8)": C.wordpiece_words(spark, sf),
        "covariance (A2)": C.covariance(spark, sf),
    }
    for name, df in jobs.items():
        out += [f"## {name}", "", "```", plan(df), "```", ""]
    open("/root/repo/PLANS.md", "w").write("\n".join(out))


if __name__ == "__main__":
    main(*sys.argv[1:])
