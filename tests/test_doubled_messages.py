"""At-least-once topics: a replayed envelope becomes one record, whichever batch brings it."""

import json

from edgelog.streaming.notify import start_notifications


def _put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def _envelope(msg_id, text):
    record = {"envelope": json.dumps({"Records": [{"Sns": {"Message": text}}]})}
    return record if msg_id is None else {"msg_id": msg_id, **record}


def test_replayed_messages_count_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        q = start_notifications(spark, str(folder), out, str(tmp_path / "ck"), files_per_batch=1)
        q.awaitTermination()
        assert q.exception() is None

    rows = [_envelope("1", "a"), _envelope("2", "b"), _envelope(None, "c"), _envelope(None, "d"), _envelope("1", "a")]
    _put(folder, "a.json", rows)
    _put(folder, "b.json", rows[:3])
    run()
    assert spark.read.parquet(out).count() == 4
    _put(folder, "c.json", [*rows, _envelope("3", "a")])  # after a restart: the state comes from the checkpoint
    run()
    assert spark.read.parquet(out).count() == 5
