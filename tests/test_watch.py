"""What a stream of texts costs: state is asked little, and only what is written is cleaned and carried."""

from collections import Counter

from pyspark.sql import Row

from corpusloom.plans import replay
from corpusloom.plans.process import process
from corpusloom.streaming import watch


class Held:
    """A piece of state that counts how often it is asked."""

    def __init__(self, value=None):
        self.value, self.asked = value, Counter()

    def get(self):
        self.asked["get"] += 1
        return self.value

    def exists(self):
        self.asked["exists"] += 1
        return self.value is not None

    def update(self, value):
        self.asked["write"] += 1
        self.value = value

    put = update


def _row(seq, own, wanted):
    shown = dict(label="csv", original="o", output="c", original_tokens=9, cleaned_tokens=4, saved=5, output_hash=own + 100) if wanted else dict.fromkeys(("label", "original", "output", "original_tokens", "cleaned_tokens", "saved", "output_hash"))
    return Row(session="s", seq=seq, own_hash=own, wanted=wanted, **shown)


def _watcher(before=None, totals=None, undo=()):
    watcher = watch.Watcher()
    watcher.before, watcher.totals, watcher.undo = Held(before), Held(totals), Held(list(undo))
    return watcher


def test_state_is_asked_once():
    new, known = _watcher(), _watcher((1, 101), (2, 10, 8), [(3,), (8,)])
    rows = [_row(14, 4, True), _row(11, 101, True), _row(12, 1, True), _row(13, 2, False)]  # 11 was written for 1, 12 is 1 again
    assert [(r.seq, r.runs, r.total_saved) for r in known.handleInputRows(("s",), iter(rows), None)] == [(14, 3, 15)]
    assert (known.before.value, known.totals.value, known.undo.value) == ((4, 104), (3, 15, 14), [(3,), (8,), (14,)])
    assert sum((x.asked for x in (known.before, known.totals, known.undo)), Counter()) == {"get": 3, "write": 3}
    assert [(r.seq, r.runs) for r in new.handleInputRows(("s",), iter(rows), None)] == [(11, 1), (12, 2), (14, 3)]
    assert sum((x.asked for x in (new.before, new.totals, new.undo)), Counter()) == {"get": 1, "write": 3}
    many = _watcher((1, 101), (2, 10, 8), [(3,), (8,)])
    assert len(list(many.handleInputRows(("s",), (_row(q, q, True) for q in range(20, 40)), None))) == 20
    assert many.undo.value == [(q,) for q in range(30, 40)] and many.undo.asked == {"write": 1}


def test_texts_of_no_use_pass_through(spark):
    plain, table = "some words \n\n\n\n\nmore words", "\n".join(["a,b,c"] * 30)
    docs = spark.createDataFrame([(0, plain), (1, table), (2, None)], "doc_id long, text string")
    whole, found = ({r.id: r for r in process(docs, through=t).collect()} for t in ((), ("text",)))
    assert found[1] == whole[1] and found[2] == whole[2]
    assert (found[0].label, found[0].cleaned, found[0].output, found[0].original_tokens) == ("text", plain, plain, None) and whole[0].cleaned != plain


def test_clipboard_reads_its_table_twice(spark, tmp_path):
    """All four showings come from one pass; a turn that stands twice is followed, and follows, twice."""
    words = " ".join(f"word{i}" for i in range(60))
    turns = [(1, 0, words), (1, 1, words + " x"), (1, 2, "plain " * 60), (1, 3, None), (2, 0, words), (2, 1, words), (2, 1, words), (3, 5, words), (None, 0, words), (None, 1, words)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = replay.clipboard(spark, str(tmp_path))
    assert sorted((r.session_id or "", r.seq, r.part_turn) for r in found.collect()) == sorted(
        [("1", 4 * t + k, t) for t in range(4) for k in range(4) if (t or k < 2) and (t, k) != (3, 3)]  # turn 2 is plain: nothing is written for it
        + [("2", k, 0) for k in (0, 1)] + [("2", 4 + k, 1) for k in range(4)] * 2 + [("3", 20 + k, 5) for k in (0, 1)] + [("", 4 * t + k, t) for t in (0, 1) for k in (0, 1)]
    )
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_commits_hold_changes(spark, tmp_path):
    """A micro-batch writes what it changed, and state is read back from that after a restart."""
    schema, src, cp = "session_id string, seq long, text string", str(tmp_path / "src"), str(tmp_path / "cp")
    table = "a,b,c\n" + "\n".join(f"{i},some cell,another cell" for i in range(40))
    for seq in (1, 2):
        spark.createDataFrame([("s", seq, table + f"\n{seq},x,y")], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        watch.start(stream, str(tmp_path / "out"), str(tmp_path / "led"), cp, availableNow=True).awaitTermination()
    assert list((tmp_path / "cp" / "state").rglob("*.changelog"))
    assert [(r.session, r.runs, r.last_seq) for r in watch.state(spark, cp).collect()] == [("s", 2, 2)]
    assert {r.seq for r in watch.state(spark, cp, "undo").collect()} == {1, 2}
