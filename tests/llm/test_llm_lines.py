from checks.compare import canonical, duck
from pagesift.llm import line_dedup as L

SMALL = "/root/testdata/sf0.001"


def test_same_rows_as_sql(spark, documents):
    got = L.dedup_lines(documents.select("doc_id", "text"))
    cur = duck(SMALL).execute(L.oracle())
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == want


def brute(rows, n=3):
    seen, gone = set(), set()
    lines = {d: t.split("\n") for d, t in rows}
    for d in sorted(lines):
        for i in range(len(lines[d]) - n + 1):
            w = tuple(lines[d][i : i + n])
            if "".join(w).strip(" ") == "":
                continue
            if w in seen:
                gone |= {(d, i + k) for k in range(n)}
            seen.add(w)
    return {
        d: "\n".join(x for i, x in enumerate(ls) if (d, i) not in gone) for d, ls in lines.items()
    }


def test_windows_overlap_and_repeat_inside_a_document(spark):
    rows = [(1, "a\nb\na\nb\na\nb\na"), (2, "x\na\nb\na\ny"), (3, "\n\n\n\n"), (4, "b\na\nb\nc"),
            (5, "a\nb"), (6, "q\nr\ns\nt"), (7, "r\ns\nt\nq\nr\ns\n")]
    got = {r.doc_id: r.text for r in
           L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(edges, empty):
    rows = L.dedup_lines(edges).collect()
    assert len(rows) == edges.count() and rows[0]["a.b"] == "own a.b"
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    one = "One line.\nTwo lines.\nThree lines.\nFour lines."
    assert by[1].count((one, 4, 0)) == 2  # equal rows count as one document
    assert by[2] == [("Else.", 4, 3)] and by[4] == [(None, 0, 0)] and by[3] == [("", 1, 0)]
    assert by[6][0][2] == 0 and L.dedup_lines(empty).count() == 0
