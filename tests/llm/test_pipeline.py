import hashlib
from collections import Counter

import corpus_pipeline
from actorlens.llm import quality
from actorlens.sources import storage
from tests.llm import test_bpe as bpe_test
from tests.llm import test_jaccard as jaccard_test
from tests.llm import test_line_dedup as line_test
from tests.llm import test_mixing as mixing_test
from tests.llm.helpers import DOCS, ascii_words, documents, empty_documents

BLANKS = " \t\n\v\f\r"


def test_stages_on_odd_rows(spark, data_dir):
    texts = [None, "", "one two three four five six seven", "one two three four five six seven", "shared line of text\nown words"]
    texts += ["shared line of text\nothers", "z " * 30_000, "BUY!! NOW!! " * 20]
    docs = documents(spark, texts, extra=True)
    docs = docs.union(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data_dir)
        if name != "tokens":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    docs.collect()


def test_empty_table(spark, data_dir):
    docs = empty_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data_dir)
    assert docs.count() == 0


def as_rows(df):
    return sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()), key=repr)


def test_every_stage_against_plain_python(spark, data_dir):
    """Each stage on what its predecessor left, beside a plain form of it."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").filter("doc_id < 400").orderBy("doc_id")
    stages = dict(corpus_pipeline.STAGES)

    labels = spark.read.parquet(f"{data_dir}/labels.parquet").filter("quality = 1").filter(~quality.held_out())
    model = quality.train(docs, labels, ~quality.held_out())
    good = {r["doc_id"] for r in model.score(docs).collect() if r["score"] >= 0.7}
    kept = stages["quality"](spark, docs, data_dir)
    assert as_rows(kept) == [r for r in as_rows(docs) if r[0] in good]
    docs = storage.materialise(kept)

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = line_test.expected(texts)
    left = {i: t for i, t in left.items() if t.strip(BLANKS) or not (texts[i] or "").strip(BLANKS)}
    kept = storage.materialise(stages["lines"](spark, docs, data_dir))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {i: (t, len(t)) for i, t in left.items()}
    assert kept.count() < docs.count()

    found = jaccard_test.brute_force(left, 5, 80)
    docs, kept = kept, storage.materialise(stages["near_copies"](spark, kept, data_dir))
    assert as_rows(kept) == [r for r in as_rows(docs) if found[r[0]][1] == r[0]]

    docs, kept = kept, storage.materialise(stages["mix"](spark, kept, data_dir))
    copies, before = Counter(as_rows(kept)), as_rows(docs)
    assert set(copies) <= set(before) and max(copies.values()) == 2
    sizes, taken, largest = Counter(), Counter(), Counter()
    for row in before:
        n, source = len(ascii_words(row[1])), row[3]
        sizes[source] += n
        taken[source] += n * copies[row]
        largest[source] = max(largest[source], n)
    wanted = mixing_test.targets_by_hand(sizes)
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in sizes)

    coder = bpe_test._reference()
    expected = sorted((i, coder.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in as_rows(kept))
    last = stages["tokens"](spark, kept, data_dir)
    assert sorted((r["doc_id"], list(r["ids"]), r["decoded_sha256"]) for r in last.collect()) == expected


def test_run_is_its_stages_in_turn(spark, data_dir):
    """The same rows as the stages one by one, and no text that the lines stage emptied."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.materialise(stage(spark, docs, data_dir))
        if name in ("near_copies", "mix"):
            assert docs.filter("text = ''").isEmpty()
    rows = sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in docs.collect())
    found = corpus_pipeline.run(spark, data_dir).collect()
    assert rows and rows == sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in found)


def test_lines_stage_drops_what_it_empties(spark, data_dir):
    texts = ["first shared line\nsecond shared line", "SECOND shared line\n \nfirst shared line", "", " \n", None, "first shared line\nown"]
    rows = corpus_pipeline.lines_stage(spark, documents(spark, texts), data_dir).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {0: texts[0], 2: "", 3: " \n", 4: "", 5: "own"}


def test_near_copies_share_five_word_shingles(spark, data_dir):
    """176 of 216 five-word shingles (0.815) make a near copy, though only 181 of 213 of four words are shared."""
    words = [f"w{i}" for i in range(200)]
    copy = [f"x{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(words)]
    far = [f"x{i}" if i in (30, 60, 90, 120, 150, 180) else w for i, w in enumerate(words)]
    docs = documents(spark, [" ".join(words), " ".join(copy), " ".join(f"y{w}" for w in words), " ".join(f"y{w}" for w in far)])
    kept = corpus_pipeline.near_copies_stage(spark, docs, data_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
