import random

from screenlab.llm.repeats import RUN_WORDS, find_repeats, units_of, without_repeats


def brute(rows):
    """(id, spans, text left) with ranks by id, null first; equal rows are one."""
    order = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    for row in order:
        for n, (_, _, words) in enumerate(units_of(row[1])):
            seen.setdefault(" ".join(words), (row, n))
    for row in order:
        cuts, run = [], []
        units = units_of(row[1])
        for n, (a, b, words) in enumerate([*units, (0, 0, None)]):
            if words is not None and seen[" ".join(words)] != (row, n):
                run.append((a, b, len(words)))
                continue
            if sum(x[2] for x in run) >= RUN_WORDS:
                cuts.append((run[0][0], run[-1][1]))
            run = []
        text = row[1]
        for a, b in reversed(cuts):
            text = text[:a] + text[b:]
        out[row] = (cuts, text)
    return sorted(((str(i), *out.get((i, t), ([], t))) for i, t in rows), key=str)


def got(df):
    rows = find_repeats(df).select("row.doc_id", "spans", "text").collect()
    return sorted(((str(r[0]), [tuple(s) for s in r[1]], r[2]) for r in rows), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    said = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(3, 30))) + "." for _ in range(15)]
    rows = [(k, rng.choice(["\n", " "]).join(rng.choice(said) for _ in range(rng.randint(1, 8)))) for k in range(60)]
    rows += [(3, None), (4, ""), rows[5], (None, said[0] + "\n" + said[1])]
    for parts in (1, 4):
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)) == brute(rows)


def test_odd_documents(odd, odd_rows, none):
    # Two of the texts differ in id alone, so ranks are plain.
    assert got(odd) == brute(odd_rows)
    left = without_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert without_repeats(none).count() == 0


def test_offsets_are_those_of_the_original(spark):
    passage = "Of all " + " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(1, passage), (2, "New here.\n" + passage.upper() + "\nEnd.")]
    row = find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).filter("row.doc_id = 2").first()
    (span,) = row["spans"]
    assert rows[1][1][span["start"] : span["end"]] == passage.upper()
    assert row["text"] == "New here.\n\nEnd."


def test_runs_of_one_word_leave_no_later_line(spark):
    rows = [(1, "Home. News\nOne of a kind."), (2, "HOME.  News\nTwo of them."), (3, "x\nTwo of them.\nhome. news")]
    found = find_repeats(spark.createDataFrame(rows, "doc_id long, text string"), run_words=1)
    left = {r["row"]["doc_id"]: r["text"].split() for r in found.collect()}
    assert left == {1: ["Home.", "News", "One", "of", "a", "kind."], 2: ["Two", "of", "them."], 3: ["x"]}
