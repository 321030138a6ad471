"""Live sources and endpoint sinks against small servers of the protocols, in threads."""

import base64
import hashlib
import http.server
import json
import socket
import struct
import threading
import time
import urllib.request

import pytest

from brookql.session import Engine
from brookql.sources import bridge
from brookql.sources.brokers import HttpPush, Mqtt, Redis, WebSocket, ZeroMq
from brookql.sources.writers import write


class Server:
    """Serves each connection with talk(socket) in a thread."""

    def __init__(self, talk):
        self.sock = socket.create_server(("127.0.0.1", 0))
        self.port, self.talk = self.sock.getsockname()[1], talk
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self):
        while True:
            try:
                c, _ = self.sock.accept()
            except OSError:
                return
            threading.Thread(target=self._serve, args=(c,), daemon=True).start()

    def _serve(self, c):
        try:
            with c:
                self.talk(c)
        except OSError:
            pass

    def close(self):
        self.sock.close()


def exactly(c, n):
    out = b""
    while len(out) < n:
        got = c.recv(n - len(out))
        if not got:
            raise OSError("closed")
        out += got
    return out


class MqttBroker(Server):
    """Keeps, for subscribers, each message until it is confirmed; delivers the rest again on every connection."""

    def __init__(self, messages=()):
        self.open, self.acked, self.published, self.connects = dict(enumerate(messages, 1)), [], [], 0
        super().__init__(self.serve)

    def read(self, c):
        head, size, shift = exactly(c, 1)[0], 0, 0
        while True:
            b = exactly(c, 1)[0]
            size, shift = size | (b & 127) << shift, shift + 7
            if b < 128:
                return head, exactly(c, size)

    def serve(self, c):
        self.connects += 1
        while True:
            head, body = self.read(c)
            kind = head >> 4
            if kind == 1:
                c.sendall(b"\x20\x02\x00\x00")
            elif kind == 8:
                c.sendall(b"\x90\x03" + body[:2] + b"\x01")
                for k, (topic, payload) in list(self.open.items()):
                    rest = struct.pack(">H", len(topic)) + topic + struct.pack(">H", k) + payload
                    size = bytes([len(rest)]) if len(rest) < 128 else bytes([len(rest) & 127 | 128, len(rest) >> 7])
                    c.sendall(b"\x32" + size + rest)
            elif kind == 4:
                k = struct.unpack(">H", body)[0]
                self.acked.append(k)
                self.open.pop(k, None)
            elif kind == 3:
                n = struct.unpack(">H", body[:2])[0]
                self.published.append((body[2 : 2 + n], body[4 + n :]))
                c.sendall(b"\x40\x02" + body[2 + n : 4 + n])
            elif kind == 14:
                return


def until(what, seconds=30):
    end = time.monotonic() + seconds
    while not what():
        assert time.monotonic() < end, "it did not happen in time"
        time.sleep(0.05)


def test_mqtt_stream_confirms_what_has_landed(spark, tmp_path, monkeypatch):
    broker = MqttBroker([(b"t/a", json.dumps({"id": i, "v": "x" * (i * 40)}).encode()) for i in range(6)])
    folder, failures = f"{tmp_path}/landed", [2]
    whole = bridge.Folder.write

    def write_or_fail(self, messages):
        if failures[0]:
            failures[0] -= 1
            raise OSError("no space")
        whole(self, messages)

    monkeypatch.setattr(bridge.Folder, "write", write_or_fail)
    e = Engine(spark)
    try:
        e.define(f'CREATE STREAM m (id BIGINT, v TEXT) WITH (TYPE="mqtt", SERVER="tcp://127.0.0.1:{broker.port}", DATASOURCE="t/#", LANDED="{folder}", LINGER="200")', stream=True)
        until(lambda: sorted(broker.acked) == [1, 2, 3, 4, 5, 6])
    finally:
        bridge.stop(folder)
        broker.close()
    assert broker.connects == 3
    from brookql.streaming.runner import stream

    query = stream(e, "SELECT id, length(v) AS n FROM m WHERE id > 1").writeStream.format("memory").queryName("mqtt_rows").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("mqtt_rows").collect())) == [(i, 40 * i) for i in range(2, 6)]
    query = stream(e, "SELECT id, lag(id) OVER () AS l FROM m").writeStream.format("memory").queryName("mqtt_lags").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("mqtt_lags").collect())) == [(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    e.define(f'CREATE STREAM again (id BIGINT) WITH (TYPE="mqtt", LANDED="{folder}")')
    assert e.sql("SELECT id FROM again").count() == 6


def test_mqtt_sink(spark):
    broker = MqttBroker()
    write(None, spark.range(5).withColumnRenamed("id", "a"), "mqtt", {"server": f"tcp://127.0.0.1:{broker.port}", "topic": "out"})
    broker.close()
    assert sorted(json.loads(p)["a"] for t, p in broker.published if t == b"out") == [0, 1, 2, 3, 4]


def test_mqtt_refusals():
    def refuse(c):
        exactly(c, 2)
        c.sendall(b"\x20\x02\x00\x05")
        time.sleep(0.5)

    server = Server(refuse)
    with pytest.raises(ConnectionError):
        Mqtt(f"tcp://127.0.0.1:{server.port}", "t")
    with pytest.raises(ValueError):
        Mqtt(f"tcp://127.0.0.1:{server.port}", "t", qos=2)
    server.close()


def redis_commands(c):
    f = c.makefile("rb")
    while line := f.readline():
        yield [f.read(int(f.readline()[1:]) + 2)[:-2] for _ in range(int(line[1:]))]


def test_redis_source_and_sink(spark):
    got = []

    def talk(c):
        for command in redis_commands(c):
            got.append(command)
            if command[0] == b"PSUBSCRIBE":
                c.sendall(b"*3\r\n$10\r\npsubscribe\r\n$2\r\nc*\r\n:1\r\n" + b"".join(b"*4\r\n$8\r\npmessage\r\n$2\r\nc*\r\n$2\r\nc1\r\n$%d\r\n%s\r\n" % (len(m), m) for m in (b"one", b"two\r\nlines")))
            else:
                c.sendall(b":1\r\n")

    server = Server(talk)
    client = Redis(f"redis://127.0.0.1:{server.port}", "c*")
    messages = []
    until(lambda: messages.extend(client.poll(0.2)) or len(messages) == 2)
    client.close()
    assert messages == [("c1", b"one"), ("c1", b"two\r\nlines")]
    write(None, spark.range(3).withColumnRenamed("id", "a"), "redis", {"addr": f"redis://127.0.0.1:{server.port}", "key": "k", "dataType": "list"})
    server.close()
    assert sorted(c[2] for c in got if c[0] == b"LPUSH") == [b'{"a":0}', b'{"a":1}', b'{"a":2}']


def greet(c):
    head = b""
    while not head.endswith(b"\r\n\r\n"):
        head += exactly(c, 1)
    key = next(line.split(": ")[1] for line in head.decode().split("\r\n") if line.startswith("Sec-WebSocket-Key"))
    accept = base64.b64encode(hashlib.sha1((key + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").encode()).digest())
    c.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")


def unmasked(c):
    head, n = exactly(c, 2)
    n &= 127
    n = struct.unpack(">H", exactly(c, 2))[0] if n == 126 else n
    mask = exactly(c, 4)
    return head & 15, bytes(x ^ mask[i % 4] for i, x in enumerate(exactly(c, n)))


def test_websocket_source_and_sink(spark):
    got, pongs = [], []

    def talk(c):
        greet(c)
        big = b"y" * 70_000
        c.sendall(b"\x81\x02hi" + b"\x89\x01p" + b"\x01\x02ab" + b"\x80\x01c" + b"\x82\x7f" + struct.pack(">Q", len(big)) + big)
        while True:
            opcode, payload = unmasked(c)
            if opcode == 8:
                return
            (pongs if opcode == 10 else got).append(payload)

    server = Server(talk)
    client, messages = WebSocket(f"ws://127.0.0.1:{server.port}/feed?x=1"), []
    until(lambda: messages.extend(client.poll(0.2)) or len(messages) == 3)
    assert [m[:3] for _, m in messages] == [b"hi", b"abc", b"yyy"] and len(messages[2][1]) == 70_000
    assert messages[0][0] == "/feed?x=1"
    until(lambda: pongs == [b"p"])
    client.close()
    write(None, spark.createDataFrame([("z" * 300,), ("q",)], "a string"), "websocket", {"addr": f"ws://127.0.0.1:{server.port}/"})
    until(lambda: len(got) == 2)
    server.close()
    assert sorted(len(json.loads(g)["a"]) for g in got) == [1, 300]


def test_zeromq_source():
    def talk(c):
        c.sendall(b"\xff" + bytes(8) + b"\x7f\x03\x00" + b"NULL".ljust(20, b"\0") + bytes(32))
        exactly(c, 64)
        flags, n = exactly(c, 2)
        assert flags == 4 and exactly(c, n).startswith(b"\x05READY")
        c.sendall(b"\x04\x06\x05READY")
        flags, n = exactly(c, 2)
        assert exactly(c, n) == b"\x01t"
        c.sendall(b"\x01\x01t" + b"\x00\x03one" + b"\x02" + struct.pack(">Q", 300) + b"t" * 300)
        time.sleep(2)

    server = Server(talk)
    client, messages = ZeroMq(f"tcp://127.0.0.1:{server.port}", "t"), []
    until(lambda: messages.extend(client.poll(0.2)) or len(messages) == 2)
    client.close()
    server.close()
    assert messages == [("t", b"one"), ("t", b"t" * 300)]


def test_http_pull_and_push(spark, tmp_path):
    answers = [b'{"id": 1}', b'{"id": 1}', b'[{"id": 2}, {"id": 3}]']

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = answers.pop(0) if len(answers) > 1 else answers[0]
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e, pulled = Engine(spark), f"{tmp_path}/pulled"
    try:
        e.define(f'CREATE STREAM h (id BIGINT) WITH (TYPE="httppull", SERVER="http://127.0.0.1:{server.server_port}/", INTERVAL="50", INCREMENTAL="true", LANDED="{pulled}", LINGER="100")', stream=True)
        until(lambda: bridge._RUNNING[pulled].landed >= 2)
        time.sleep(0.3)
    finally:
        bridge.stop(pulled)
        server.shutdown()
    e.define(f'CREATE STREAM h2 (id BIGINT) WITH (TYPE="httppull", LANDED="{pulled}")')
    assert sorted(r.id for r in e.sql("SELECT id FROM h2").collect()) == [1, 2, 3]

    push = HttpPush("127.0.0.1:0", "/in", limit=100)
    answered = []

    def post(path, body):
        try:
            answered.append(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{push.port}{path}", body), timeout=30).status)
        except urllib.error.HTTPError as error:
            answered.append(error.code)

    t = threading.Thread(target=post, args=("/in", b'{"id": 4}'))
    t.start()
    messages = []
    until(lambda: messages.extend(push.poll(0.2)) or messages)
    assert messages == [("/in", b'{"id": 4}')] and not answered
    push.done()
    t.join(30)
    post("/elsewhere", b"{}")
    post("/in", b"x" * 101)
    push.close()
    assert answered == [200, 404, 413]


def test_influx_sink(spark):
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.path, self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("a", 1, 5)], "host string, v long, t long").coalesce(1)
    write(None, df, "influx2", {"addr": f"http://127.0.0.1:{server.server_port}", "org": "o", "bucket": "b", "token": "k", "measurement": "m", "tags": ["host"], "tsFieldName": "t"})
    server.shutdown()
    assert got == [("/api/v2/write?org=o&bucket=b&precision=ms", "Token k", "m,host=a v=1i 5")]
