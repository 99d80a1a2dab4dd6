from helpers import SCHEMA, no_documents, odd_documents

from textloom.llm import line_spread


def reference(rows, min_sites):
    """(doc_id, text) -> text without lines of min_sites sites or more, but for the smallest id's."""
    sites, keeper = {}, {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line, set()).add(r.source or "")
                if r.doc_id is not None:
                    keeper[line] = min(keeper.get(line, r.doc_id), r.doc_id)
    gone = {x for x, s in sites.items() if len(s) >= min_sites and x in keeper}
    return sorted(((r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if x not in gone or keeper[x] == r.doc_id)) for r in rows), key=str)


def check(docs, min_sites, lg=12):
    got = line_spread.remove_boilerplate(docs, min_sites=min_sites, lg=lg)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == reference(docs.collect(), min_sites)


def test_against_brute_force(spark):
    texts = [f"shared line\nown line {i}\n\n" + ("half shared\n" if i % 2 else "") + f"last {i % 5}" for i in range(40)]
    docs = odd_documents(spark, texts)
    for min_sites in (1, 2, 3, 4):
        check(docs, min_sites)


def test_near_the_threshold_counts_are_exact(spark):
    # With 16 buckets the sketch is off by a quarter: lines of 30 to 50 sites around a threshold of 40 need exact counts.
    rows = [(k * 1000 + s, f"line {k}\nown {k} {s}", "en", f"site{s}", 1, "x", 0.5, 1, "y") for k in range(30, 51) for s in range(k)]
    check(spark.createDataFrame(rows, SCHEMA), 40, lg=4)


def test_hot_line_and_empty_table(spark):
    assert line_spread.remove_boilerplate(no_documents(spark)).count() == 0
    rows = [(i, "hot\n" * 3 + f"own {i}", "en", f"s{i % 9}", 1, "x", 0.5, 1, "y") for i in range(500)]
    got = line_spread.remove_boilerplate(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert got[0].n_removed == 0 and all(x.n_removed == 3 and x.text == f"own {x.doc_id}" for x in got[1:])


def test_columns_of_any_name_are_handed_on(spark):
    rows = [(i, f"s{i}", "same line\nown line " + str(i), f"a{i}", f"b{i}", f"c{i}", 9, f"e{i}", f"f{i}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, d string, t string, removed string, N_lines int, `__removed` string, h string")
    got = line_spread.remove_boilerplate(docs)
    assert got.columns == ["doc_id", "source", "text", "d", "t", "removed", "__removed", "h", "n_lines", "n_removed"]
    assert sorted((x.doc_id, x.d, x.t, x.removed, x["__removed"], x.h) for x in got.collect()) == [(r[0], r[3], r[4], r[5], r[7], r[8]) for r in rows]
    assert got.where("n_removed = 1").count() == 7
