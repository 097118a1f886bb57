"""Fetching and searching rules over a network made up for the test."""

import json

import pytest

from textloom.sources import transport as net
from textloom.sources.transport import Refused, Reply

PUBLIC = {"x.org": ["93.184.216.34"], "y.org": ["93.184.216.35", "2606:2800:220:1::1"], "in.org": ["93.184.216.34", "10.0.0.1"], "v6.org": ["fe80::1%eth0"]}


def resolve(host, port):
    if host not in PUBLIC:
        raise OSError
    return PUBLIC[host]


def permitted(url):
    return url.split("#")[0] if url.startswith("https://") and "no" not in url else None


class Clock:
    def __init__(self):
        self.t = 0.0

    def __call__(self):
        return self.t

    def sleep(self, s):
        self.t += s


def web(pages, clock=None, cost=1.0):
    def get(url, left):
        if clock:
            clock.t += cost
        page = pages[url]
        if isinstance(page, Exception):
            raise page
        return page

    return get


HTML = {"Content-Type": "Text/HTML; charset=utf-8"}


@pytest.mark.parametrize("pages,want", [
    ({"https://x.org/a": Reply(200, b"hi", HTML)}, ("https://x.org/a", "text/html")), ({"https://x.org/a": Reply(302, headers={"location": "//y.org/b"}), "https://y.org/b": Reply(200, b"", HTML)}, ("https://y.org/b", "text/html")),
    ({"https://x.org/a": Reply(301, headers={"Location": "https://x.org/no"})}, "policy_rejected"), ({"https://x.org/a": Reply(301, headers={"Location": "http://x.org/"})}, "policy_rejected"), ({"https://x.org/a": Reply(301)}, "invalid_redirect"),
    ({"https://x.org/a": Reply(307, headers={"Location": "https://in.org/"})}, "unsafe_address"), ({"https://x.org/a": Reply(307, headers={"Location": "https://v6.org/"})}, "unsafe_address"), ({"https://x.org/a": Reply(307, headers={"Location": "https://gone.org/"})}, "dns_failure"),
    ({"https://x.org/a": Reply(308, headers={"Location": "/a"})}, "redirect_limit"), ({"https://x.org/a": Reply(404)}, "http_error"), ({"https://x.org/a": Reply(200, b"", {"Content-Type": "image/png"})}, "unsupported_content_type"), ({"https://x.org/a": Reply(200)}, "unsupported_content_type"),
    ({"https://x.org/a": Reply(200, b"", HTML | {"Content-Length": "99"})}, "oversized"), ({"https://x.org/a": Reply(200, b"x" * 51, HTML)}, "oversized"), ({"https://x.org/a": Reply(200, b"", HTML | {"Content-Length": "x"})}, "invalid_response"),
    ({"https://x.org/a": Reply(200, b"", HTML, "https://x.org/no")}, "policy_rejected"), ({"https://x.org/a": TimeoutError()}, "timeout"), ({"https://x.org/a": OSError()}, "network_error"),
])
def test_follow(pages, want):
    def go():
        return net.follow("https://x.org/a", web(pages), permitted, resolve, 60, max_bytes=50, clock=Clock())[:2]

    if isinstance(want, tuple):
        assert go() == want
    else:
        with pytest.raises(Refused) as e:
            go()
        assert e.value.code == want


def test_follow_keeps_the_deadline():
    clock = Clock()
    loop = {f"https://x.org/{i}": Reply(302, headers={"Location": f"/{i + 1}"}) for i in range(9)}
    with pytest.raises(Refused) as e:
        net.follow("https://x.org/0", web(loop, clock, 4), permitted, resolve, 10, max_redirects=8, clock=clock)
    assert e.value.code == "timeout" and clock.t == 12


def test_fetch_all(spark):
    def connect():
        return (lambda url, left: Reply(200, b"hi", {"Content-Type": "text/plain"})), (lambda u: u if u.startswith("https://") else None), (lambda h, p: ["93.184.216.34"])

    got = net.fetch_all(spark.createDataFrame([("https://x.org/",), ("http://x.org/",), (None,)], "url string"), connect).collect()
    assert sorted((r["url"] or "", r["status"], r["mime"], bytes(r["body"] or b"")) for r in got) == [("", "policy_rejected", None, b""), ("http://x.org/", "policy_rejected", None, b""), ("https://x.org/", "ok", "text/plain", b"hi")]


def say(**headers):
    return {k.replace("_", "-"): v for k, v in headers.items()}


def series(replies, clock, cost=0.0):
    it = iter(replies)

    def get(url, left):
        clock.t += cost
        r = next(it)
        if isinstance(r, Exception):
            raise r
        return r

    return get


GOOD = Reply(200, json.dumps({"web": {"results": [{"title": " A \n b", "url": "https://x.org/a ", "description": "s", "page_age": "2024"}, 7]}}).encode())


@pytest.mark.parametrize("replies,tries,waited,code", [
    ([GOOD], 1, 0, None), ([OSError(), GOOD], 2, 0.25, None), ([OSError(), OSError()], 2, 0.25, "network"), ([Reply(500), Reply(503), GOOD], 3, 0.75, None), ([Reply(500)] * 3, 3, 0.75, "provider_failure"), ([Reply(404)], 1, 0, "provider_failure"),
    ([Reply(401)], 1, 0, "authentication"), ([Reply(402)], 1, 0, "quota_exhausted"), ([Reply(429)], 1, 0, "rate_limit"), ([Reply(429, headers=say(Retry_After="2")), GOOD], 2, 2, None), ([Reply(429, headers=say(Retry_After="0")), GOOD], 2, 0, None),
    ([Reply(429, headers=say(X_RateLimit_Reset="3, 90000", X_RateLimit_Remaining="0, 5")), GOOD], 2, 3, None), ([Reply(429, headers=say(X_RateLimit_Reset="1, 90000", X_RateLimit_Remaining="1, 0"))], 1, 0, "quota_exhausted"),
    ([Reply(429, headers=say(Retry_After="1")), Reply(429, headers=say(Retry_After="1"))], 2, 1, "rate_limit"), ([Reply(429, headers=say(Retry_After="60"))], 1, 0, "rate_limit"), ([TimeoutError()], 1, 0, "timeout"),
    ([Reply(200, b"[1]")], 1, 0, "invalid_response"), ([Reply(200, b"{")], 1, 0, "invalid_response"), ([Reply(200, b"\xff")], 1, 0, "invalid_response"), ([Reply(200, b" " * (net.MAX_SEARCH_BYTES + 1))], 1, 0, "invalid_response"),
])
def test_ask(replies, tries, waited, code):
    clock = Clock()
    if code is None:
        found, n = net.ask("u", series(replies, clock), 10, clock=clock, sleep=clock.sleep, now=lambda: 0.0)
        assert n == tries and net.hits(found) == [{"title": "A b", "url": "https://x.org/a", "snippet": "s", "published": "2024"}]
    else:
        with pytest.raises(Refused) as e:
            net.ask("u", series(replies, clock), 10, clock=clock, sleep=clock.sleep, now=lambda: 0.0)
        assert e.value.code == code
    assert clock.t == waited


def test_ask_keeps_the_deadline():
    clock = Clock()
    with pytest.raises(Refused) as e:
        net.ask("u", series([Reply(500)] * 9, clock, 6), 10, clock=clock, sleep=clock.sleep, now=lambda: 0.0)
    assert e.value.code in ("timeout", "provider_failure") and clock.t < 13


def test_rate_limit_headers():
    r = lambda **h: Reply(429, headers=say(**h))
    assert net.windows("1;w=1, x, 2.5") == [1.0, 2.5] and net.resets(r(X_RateLimit_Reset="5,2000000000"), 1999999990.0) == [5.0, 10.0]
    assert net.asked_to_wait(r(Retry_After="Thu, 01 Jan 1970 00:01:00 GMT"), 20.0) == 40.0 and net.asked_to_wait(r(Retry_After="soon"), 0) is None and net.asked_to_wait(r(), 0) is None
    assert net.quota_used_up(r(X_RateLimit_Remaining="0", X_RateLimit_Reset="86400"), 0) and not net.quota_used_up(r(X_RateLimit_Remaining="0", X_RateLimit_Reset="10"), 0)
    assert not net.quota_used_up(r(X_RateLimit_Remaining="0,3", X_RateLimit_Reset="1,99999"), 0) and not net.quota_used_up(r(), 0)
    with pytest.raises(Refused):
        net.hits({"web": {"results": {}}})
