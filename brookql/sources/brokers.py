"""Clients of message brokers and endpoints, over plain sockets.

A receiver has poll(seconds), which returns the messages that came as (topic, payload),
and done(), which tells the other side that all of these are safe; close() ends it.
Senders have send(payloads) and close(). MQTT 3.1.1 (QoS 0 and 1), Redis
(RESP 2), WebSocket (RFC 6455), ZeroMQ (ZMTP 3.0, no security), HTTP pull and push.
"""

from __future__ import annotations

import base64
import hashlib
import http.server
import os
import select
import socket
import ssl
import struct
import threading
import time
import urllib.parse
import urllib.request
import uuid


class Wire:
    """A socket with a buffer of what came."""

    def __init__(self, url: str, port: int, timeout: float = 30.0) -> None:
        at = urllib.parse.urlsplit(url if "://" in url else f"tcp://{url}")
        self.host, self.port, self.path = at.hostname or "localhost", at.port or port, at.path or "/"
        if at.query:
            self.path += f"?{at.query}"
        self.user, self.password = at.username, at.password
        self.sock = socket.create_connection((self.host, self.port), timeout)
        if at.scheme in ("ssl", "tls", "mqtts", "wss", "rediss"):
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=self.host)
        self.buffer = bytearray()

    def fill(self, seconds: float) -> bool:
        """Add what comes within the time to the buffer; whether anything came."""
        pending = isinstance(self.sock, ssl.SSLSocket) and self.sock.pending()
        if not pending and not select.select([self.sock], [], [], max(0.0, seconds))[0]:
            return False
        data = self.sock.recv(1 << 16)
        if not data:
            raise ConnectionError(f"{self.host}:{self.port} closed the connection")
        self.buffer += data
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.fill(30.0):
                raise TimeoutError(f"{self.host}:{self.port} sent nothing")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def until(self, mark: bytes) -> bytes:
        while (k := self.buffer.find(mark)) < 0:
            if not self.fill(30.0):
                raise TimeoutError(f"{self.host}:{self.port} sent nothing")
        return self.take(k + len(mark))[: -len(mark)]

    def send(self, data: bytes) -> None:
        self.sock.sendall(data)

    def close(self) -> None:
        self.sock.close()


class Receiver:
    """A receiver on one connection; a subclass parses messages with next(wire)."""

    wire: Wire

    def poll(self, seconds: float) -> list[tuple[str, bytes]]:
        out, end = [], time.monotonic() + seconds
        while self.wire.buffer or self.wire.fill(end - time.monotonic()):
            message = self.next()
            if message is not None:
                out.append(message)
            if time.monotonic() >= end or len(out) >= 10_000:
                break
        return out

    def next(self) -> tuple[str, bytes] | None:
        raise NotImplementedError

    def done(self) -> None:
        pass

    def close(self) -> None:
        self.wire.close()


# MQTT ----------------------------------------------------------------------------------


def _packet(head: int, body: bytes) -> bytes:
    n, size = len(body), bytearray()
    while True:
        n, low = divmod(n, 128)
        size.append(low | (128 if n else 0))
        if not n:
            return bytes([head]) + bytes(size) + body


def _string(text: str) -> bytes:
    data = text.encode()
    return struct.pack(">H", len(data)) + data


class Mqtt(Receiver):
    """Subscribes or publishes. A session under a given client id outlives the connection, so messages of QoS 1 that were not safe come again."""

    KEEPALIVE = 60

    def __init__(self, server: str, topic: str | None = None, qos: int = 1, client: str | None = None, user: str | None = None, password: str | None = None) -> None:
        if not 0 <= qos <= 1:
            raise ValueError("QoS 0 and 1 are supported")
        self.wire, self.qos, self.unsafe, self.packet, self.acked = Wire(server, 1883), qos, [], 0, set()
        user, password = user or self.wire.user, password or self.wire.password
        flags = (0 if client else 2) | (0x80 if user else 0) | (0x40 if password else 0)
        body = _string("MQTT") + bytes([4, flags]) + struct.pack(">H", self.KEEPALIVE) + _string(client or f"b{uuid.uuid4().hex[:20]}")
        self.wire.send(_packet(0x10, body + (_string(user) if user else b"") + (_string(password) if password else b"")))
        kind, answer = self._read()
        if kind >> 4 != 2 or answer[1]:
            raise ConnectionError(f"the broker refused with code {answer[1:2].hex()}")
        self.early: list[tuple[str, bytes]] = []
        if topic is not None:
            self.packet += 1
            wanted = b"".join(_string(t.strip()) + bytes([qos]) for t in topic.split(","))
            self.wire.send(_packet(0x82, struct.pack(">H", self.packet) + wanted))
            # a kept session may deliver before it confirms
            while (got := self._read())[0] >> 4 != 9:
                self._handle(*got, self.early)
            if 0x80 in got[1][2:]:
                raise ConnectionError(f"the broker refused to subscribe to {topic}")
        self.sent = time.monotonic()

    def _read(self) -> tuple[int, bytes]:
        head, size, shift = self.wire.take(1)[0], 0, 0
        while True:
            b = self.wire.take(1)[0]
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                return head, self.wire.take(size)

    def _handle(self, head: int, body: bytes, out: list) -> None:
        if head >> 4 == 4:
            self.acked.add(struct.unpack(">H", body[:2])[0])
        if head >> 4 != 3:
            return
        n = struct.unpack(">H", body[:2])[0]
        topic, rest = body[2 : 2 + n].decode(), body[2 + n :]
        if head >> 1 & 3:
            self.unsafe.append(rest[:2])
            rest = rest[2:]
        out.append((topic, rest))

    def poll(self, seconds: float) -> list[tuple[str, bytes]]:
        if time.monotonic() - self.sent > self.KEEPALIVE / 3:
            self.wire.send(b"\xc0\x00")
            self.sent = time.monotonic()
        early, self.early = self.early, []
        return early + super().poll(seconds)

    def next(self):
        out: list[tuple[str, bytes]] = []
        self._handle(*self._read(), out)
        return out[0] if out else None

    def done(self) -> None:
        for packet in self.unsafe:
            self.wire.send(b"\x40\x02" + packet)
        self.unsafe.clear()

    def publish(self, topic: str, payload: bytes, retain: bool = False) -> None:
        self.packet = self.packet % 65535 + 1
        ident = struct.pack(">H", self.packet) if self.qos else b""
        self.wire.send(_packet(0x30 | self.qos << 1 | retain, _string(topic) + ident + payload))
        if self.qos:
            while self.packet not in self.acked:
                self._handle(*self._read(), [])
            self.acked.discard(self.packet)

    def close(self) -> None:
        try:
            self.wire.send(b"\xe0\x00")
        finally:
            self.wire.close()


# Redis ---------------------------------------------------------------------------------


class Redis(Receiver):
    """Listens to channels (patterns where they hold * or ?), or runs commands."""

    def __init__(self, server: str, channels: str | None = None, password: str | None = None, db: int = 0) -> None:
        self.wire = Wire(server, 6379)
        if password or self.wire.password:
            self.command("AUTH", password or self.wire.password)
        if db:
            self.command("SELECT", str(db))
        for c in (channels or "").split(","):
            if c.strip():
                self._ask("PSUBSCRIBE" if set("*?[") & set(c) else "SUBSCRIBE", c.strip())

    def _ask(self, *parts: str | bytes) -> None:
        raw = [p if isinstance(p, bytes) else str(p).encode() for p in parts]
        self.wire.send(b"*%d\r\n" % len(raw) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in raw))

    def _reply(self):
        line = self.wire.until(b"\r\n")
        kind, rest = line[:1], line[1:]
        if kind == b"-":
            raise ConnectionError(rest.decode())
        if kind == b":":
            return int(rest)
        if kind == b"$":
            return None if rest == b"-1" else self.wire.take(int(rest) + 2)[:-2]
        if kind == b"*":
            return [self._reply() for _ in range(int(rest))]
        return rest

    def command(self, *parts: str | bytes):
        self._ask(*parts)
        return self._reply()

    def next(self):
        r = self._reply()
        return (r[-2].decode(), r[-1]) if isinstance(r, list) and r and r[0] in (b"message", b"pmessage") else None


# WebSocket -----------------------------------------------------------------------------


class WebSocket(Receiver):
    """A client of a WebSocket server; its text and binary messages."""

    def __init__(self, server: str, headers: dict | None = None) -> None:
        self.wire, self.parts = Wire(server, 443 if server.startswith("wss") else 80), bytearray()
        key = base64.b64encode(os.urandom(16)).decode()
        lines = [f"GET {self.wire.path} HTTP/1.1", f"Host: {self.wire.host}:{self.wire.port}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", "Sec-WebSocket-Version: 13"]
        self.wire.send("\r\n".join([*lines, *[f"{k}: {v}" for k, v in (headers or {}).items()], "", ""]).encode())
        answer = self.wire.until(b"\r\n\r\n").decode("latin-1")
        # the fixed key suffix of RFC 6455
        expected = base64.b64encode(hashlib.sha1((key + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").encode()).digest()).decode()
        if " 101 " not in answer.split("\r\n")[0] + " " or expected not in answer:
            raise ConnectionError(f"no WebSocket: {answer.splitlines()[0]}")

    def _frame(self, opcode: int, payload: bytes) -> None:
        n = len(payload)
        size = bytes([0x80 | n]) if n < 126 else b"\xfe" + struct.pack(">H", n) if n < 1 << 16 else b"\xff" + struct.pack(">Q", n)
        mask = os.urandom(4)
        whole = int.from_bytes(payload, "big") ^ int.from_bytes((mask * (n // 4 + 1))[:n], "big")
        self.wire.send(bytes([0x80 | opcode]) + size + mask + whole.to_bytes(n, "big"))

    def next(self):
        head, n = self.wire.take(2)
        if n & 127 == 126:
            size = struct.unpack(">H", self.wire.take(2))[0]
        elif n & 127 == 127:
            size = struct.unpack(">Q", self.wire.take(8))[0]
        else:
            size = n & 127
        payload, opcode = self.wire.take(size), head & 15
        if opcode == 8:
            raise ConnectionError("the server closed the WebSocket")
        if opcode == 9:
            self._frame(10, payload)
        if opcode > 2:
            return None
        self.parts += payload
        if not head & 0x80:
            return None
        message, self.parts = bytes(self.parts), bytearray()
        return self.wire.path, message

    def send(self, payload: bytes) -> None:
        self._frame(1, payload)


# ZeroMQ --------------------------------------------------------------------------------


class ZeroMq(Receiver):
    """A SUB socket on a PUB socket's address; a message's last part is its payload."""

    def __init__(self, server: str, topic: str = "") -> None:
        self.wire, self.parts, self.topic = Wire(server, 5556), [], topic
        self.wire.send(b"\xff" + bytes(8) + b"\x7f\x03\x00" + b"NULL".ljust(20, b"\0") + bytes(32))
        if self.wire.take(64)[12:16] != b"NULL":
            raise ConnectionError("the socket asks for security")
        ready = b"\x05READY" + b"\x0bSocket-Type" + struct.pack(">I", 3) + b"SUB"
        self.wire.send(bytes([4, len(ready)]) + ready)
        while not self._part()[0] & 4:
            pass
        wanted = b"\x01" + topic.encode()
        self.wire.send((bytes([0, len(wanted)]) if len(wanted) < 256 else b"\x02" + struct.pack(">Q", len(wanted))) + wanted)

    def _part(self) -> tuple[int, bytes]:
        flags = self.wire.take(1)[0]
        return flags, self.wire.take(struct.unpack(">Q", self.wire.take(8))[0] if flags & 2 else self.wire.take(1)[0])

    def next(self):
        flags, data = self._part()
        if flags & 4:
            return None
        self.parts.append(data)
        if flags & 1:
            return None
        parts, self.parts = self.parts, []
        return parts[0].decode("utf-8", "replace") if len(parts) > 1 else self.topic, parts[-1]


# HTTP ----------------------------------------------------------------------------------


class HttpPull:
    """Asks a URL every interval; with incremental, an answer equal to the last one is left out."""

    def __init__(self, url: str, interval: float = 1.0, method: str = "GET", body: str | None = None, headers: dict | None = None, incremental: bool = False) -> None:
        self.request = urllib.request.Request(url, body.encode() if body else None, headers or {}, method=method.upper())
        self.url, self.interval, self.incremental, self.last, self.due = url, interval, incremental, None, 0.0

    def poll(self, seconds: float) -> list[tuple[str, bytes]]:
        wait = self.due - time.monotonic()
        if wait > 0:
            time.sleep(min(wait, seconds))
            if wait > seconds:
                return []
        self.due = time.monotonic() + self.interval
        with urllib.request.urlopen(self.request, timeout=30) as answer:
            body = answer.read()
        if not body or self.incremental and body == self.last:
            return []
        self.last = body
        return [(self.url, body)]

    def done(self) -> None:
        pass

    def close(self) -> None:
        pass


class HttpPush:
    """Takes what is posted to a path; a post is answered once its rows are safe."""

    def __init__(self, address: str, path: str = "/", method: str = "POST", limit: int = 10 << 20) -> None:
        host, _, port = address.rpartition(":")
        self.waiting: list[tuple[bytes, threading.Event]] = []
        self.taken: list[threading.Event] = []
        self.lock, self.path, receiver = threading.Condition(), path, self

        class Handler(http.server.BaseHTTPRequestHandler):
            def handle_any(self) -> None:
                size = int(self.headers.get("Content-Length") or 0)
                status = 404 if self.path.split("?")[0] != path else 413 if size > limit else 405 if self.command != method.upper() else 0
                if not status:
                    status = 200 if receiver.take(self.rfile.read(size)) else 503
                self.send_response(status)
                self.send_header("Content-Length", "0")
                self.end_headers()

            do_POST = do_PUT = do_GET = handle_any

            def log_message(self, *args) -> None:
                pass

        self.server = http.server.ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
        self.server.daemon_threads = True
        self.port = self.server.server_port
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def take(self, body: bytes) -> bool:
        safe = threading.Event()
        with self.lock:
            self.waiting.append((body, safe))
            self.lock.notify()
        return safe.wait(60)

    def poll(self, seconds: float) -> list[tuple[str, bytes]]:
        with self.lock:
            self.lock.wait_for(lambda: self.waiting, seconds)
            got, self.waiting = self.waiting, []
        self.taken += [e for _, e in got]
        return [(self.path, body) for body, _ in got]

    def done(self) -> None:
        for e in self.taken:
            e.set()
        self.taken.clear()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


# By TYPE -------------------------------------------------------------------------------


def receiver(kind: str, o: dict):
    """The receiver of a source's TYPE, from its options."""
    topic, server = o.get("DATASOURCE", ""), o.get("SERVER", "")
    if kind in ("mqtt", "edgex"):
        return Mqtt(server or "tcp://localhost:1883", topic or "#", int(o.get("QOS", "1")), o.get("CLIENTID"), o.get("USERNAME"), o.get("PASSWORD"))
    if kind == "redissub":
        return Redis(server or "redis://localhost:6379", topic, o.get("PASSWORD"), int(o.get("DB", "0")))
    if kind == "websocket":
        return WebSocket(server or topic)
    if kind in ("zmq", "zeromq"):
        return ZeroMq(server, topic)
    if kind == "httppull":
        return HttpPull(server or topic, int(o.get("INTERVAL", "1000")) / 1000, o.get("METHOD", "GET"), o.get("BODY"), incremental=o.get("INCREMENTAL", "false").lower() == "true")
    if kind == "httppush":
        return HttpPush(server or "0.0.0.0:10081", topic or "/", o.get("METHOD", "POST"))
    return None


LIVE = ("mqtt", "edgex", "redissub", "websocket", "zmq", "zeromq", "httppull", "httppush")


def _mqtt_sink(rows, props: dict) -> None:
    client = Mqtt(props.get("server", "tcp://localhost:1883"), None, int(props.get("qos", 1)), user=props.get("username"), password=props.get("password"))
    try:
        for row in rows:
            client.publish(props["topic"], row.encode(), bool(props.get("retained", False)))
    finally:
        client.close()


def _redis_sink(rows, props: dict) -> None:
    """Publishes to a channel, or sets or pushes to a key."""
    client = Redis(props.get("addr", "redis://localhost:6379"), None, props.get("password"), int(props.get("db", 0)))
    try:
        for row in rows:
            if props.get("channel"):
                client.command("PUBLISH", props["channel"], row)
            else:
                client.command("LPUSH" if props.get("dataType", "string") == "list" else "SET", props["key"], row)
    finally:
        client.close()


def _websocket_sink(rows, props: dict) -> None:
    client = WebSocket(props["addr"], props.get("headers"))
    try:
        for row in rows:
            client.send(row.encode())
        client._frame(8, b"")
    finally:
        client.close()


def _influx_sink(rows, props: dict) -> None:
    """Posts line protocol, batchSize lines at a time."""
    url, batch = props["addr"].rstrip("/"), []
    if "org" in props or "bucket" in props:
        url += "/api/v2/write?" + urllib.parse.urlencode({"org": props.get("org", ""), "bucket": props.get("bucket", ""), "precision": props.get("precision", "ms")})
    else:
        url += "/write?" + urllib.parse.urlencode({"db": props.get("database", ""), "precision": props.get("precision", "ms")})
    headers = {"Content-Type": "text/plain; charset=utf-8"} | ({"Authorization": f"Token {props['token']}"} if "token" in props else {})

    def post() -> None:
        urllib.request.urlopen(urllib.request.Request(url, "\n".join(batch).encode(), headers), timeout=30).close()
        batch.clear()

    for row in rows:
        batch.append(row)
        if len(batch) >= int(props.get("batchSize", 1000)):
            post()
    if batch:
        post()


#: Deliveries of endpoint sinks that are built in.
SINKS = {"mqtt": _mqtt_sink, "edgex": _mqtt_sink, "redis": _redis_sink, "websocket": _websocket_sink, "influx": _influx_sink, "influx2": _influx_sink}
