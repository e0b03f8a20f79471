"""Polling with offsets of its own, recovery of interrupted work, and streaks, across restarts."""

import datetime
import http.server
import json
import threading
import urllib.parse

import pytest

from gridlake.streaming import jobs, polling, stateful

T0 = datetime.datetime(2026, 7, 20, 9, 0)


class Answer(Exception):
    def __init__(self, status):
        self.status = status


def test_back_off():
    waits, left = [], [409, 500, None]

    def call():
        if left:
            raise Answer(left.pop(0))
        return "ok"

    assert polling.backing_off(call, sleep=waits.append) == "ok" and waits == [15.0, 10.0, 10.0]
    left[:] = [409] * 3
    with pytest.raises(Answer):
        polling.backing_off(call, attempts=2, sleep=waits.append)


@pytest.fixture
def feed():
    """An address on this host: updates to come, failures to answer first, the offsets asked for."""
    state = {"updates": [], "failures": [], "asked": []}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            offset, limit = int(asked["offset"][0]), int(asked["limit"][0])
            state["asked"].append(offset)
            status = state["failures"].pop(0) if state["failures"] else 200
            found = state["updates"][-1:] if offset == -1 else [u for u in state["updates"] if u["update_id"] >= offset][:limit]
            body = json.dumps({"result": found}).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/updates", state
    server.shutdown()


def no_wait(_):
    pass


@pytest.mark.parametrize("span", [None, 2])
def test_polling_across_restarts(spark, tmp_path, feed, span):
    address, state = feed
    name = f"polled_{span or 'all'}"
    spark.dataSource.register(polling.polling_source(polling.HttpFeed(address, page=3), name, span, sleep=no_wait))
    add = lambda *ids: state["updates"].extend({"update_id": i, "text": f"t{i}"} for i in ids)
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run():
        source = spark.readStream.format(name).load()
        jobs.upsert_batches(source, out, checkpoint, ["update_id"]).awaitTermination()

    ids = lambda: sorted(r.update_id for r in jobs.latest(spark.read.parquet(out), ["update_id"]).collect())
    add(1, 2, 3)
    run()  # the first start skips the backlog
    add(7, 8, 9, 12, 13)
    state["failures"] += [409, 503]
    run()
    assert ids() == [7, 8, 9, 12, 13]
    add(14, 20)
    run()
    run()
    assert ids() == [7, 8, 9, 12, 13, 14, 20]
    body = {r.update_id: json.loads(r.body) for r in spark.read.parquet(out).collect()}
    assert body[20] == {"update_id": 20, "text": "t20"}


def test_a_batch_that_was_cut_off_is_read_again(spark, tmp_path, feed):
    address, state = feed
    spark.dataSource.register(polling.polling_source(polling.HttpFeed(address), "polled_cut", sleep=no_wait))
    checkpoint, kept = f"{tmp_path}/checkpoint", []

    def run(fail):
        def put(batch, number):
            kept.extend((r.update_id, number) for r in batch.collect())
            if fail:
                raise RuntimeError("the driver was lost")

        spark.readStream.format("polled_cut").load().writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(False)
    state["updates"] += [{"update_id": i} for i in (1, 2)]
    with pytest.raises(Exception, match="driver was lost"):
        run(True)
    state["updates"].append({"update_id": 3})
    run(False)  # what was planned before
    run(False)
    assert {i for i, _ in kept} == {1, 2, 3}
    first = {i: n for i, n in kept}
    assert kept.count((1, first[1])) == 2  # the same batch once more, under its number: a keyed sink holds it once


def feed_files(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_recovery_across_restarts(spark, tmp_path):
    schema = "update_id long, event string, ts timestamp, text string"
    at = lambda minutes: T0 + datetime.timedelta(minutes=minutes)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(*rows):
        feed_files(spark, folder, list(rows), schema)
        source = spark.readStream.schema(schema).json(folder)
        jobs.run_available(stateful.recovered(source), out, f"{tmp_path}/checkpoint")
        return sorted((r.update_id, r.action, r.attempt, r.preview) for r in spark.read.parquet(out).collect())

    long = "x" * 200
    assert run((1, "start", at(0), "one"), (2, "start", at(0), "two"), (2, "done", at(1), None), (3, "start", at(2), long)) == []
    # time passes 0:10 and 0:12 by more than the lateness: one and three are tried again
    assert run((9, "start", at(25), "nine"), (9, "done", at(26), None), (1, "start", at(1), "again")) == [(1, "retry", 2, "one"), (3, "retry", 2, "x" * 80)]
    # three ends; one is cut off a second time
    assert run((3, "done", at(27), None), (10, "start", at(60), "ten"), (10, "done", at(61), None)) == [(1, "drop", 2, "one"), (1, "retry", 2, "one"), (3, "retry", 2, "x" * 80)]
    assert len(run((11, "start", at(120), "e"), (11, "done", at(121), None))) == 3


def test_streaks_across_restarts(spark, tmp_path):
    schema = "job string, ts timestamp, run_id long, ok boolean, error string"
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    number = iter(range(1000))

    def run(**outcomes):
        rows = []
        for job, marks in outcomes.items():
            rows += [(job, T0 + datetime.timedelta(minutes=n), n, {"+": True, "-": False, "?": None}[m], f"e{n}") for m, n in zip(marks, number)]
        feed_files(spark, folder, rows[::-1], schema)
        jobs.run_available(stateful.streak_alerts(spark.readStream.schema(schema).json(folder)), out, f"{tmp_path}/checkpoint")
        return sorted((r.job, r.run_id, r.failures) for r in spark.read.parquet(out).collect())

    assert run(a="+---", b="-----") == []
    assert run(a="--", b="?--") == [("b", 11, 6)]  # a null outcome is a failure
    assert run(a="-----", b="+-----") == [("a", 14, 6), ("b", 11, 6)]  # told once, though failures go on
    assert run(a="+", b="-") == [("a", 14, 6), ("b", 11, 6), ("b", 26, 6)]
