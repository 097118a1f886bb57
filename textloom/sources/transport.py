"""Rules for fetching and searching over an injected network: who may be asked, how often, and until when. No network code lives here.

A transport is a function (url, seconds left) -> ``Reply``; it may raise ``TimeoutError``
or ``OSError``. Clock and sleep are parameters too, so every rule can be tested.
"""

from __future__ import annotations

import datetime
import ipaddress
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

# --- Fixed values ---
MAX_BYTES, MAX_REDIRECTS, MAX_SEARCH_BYTES = 12 << 20, 5, 2 << 20
CONTENT_TYPES = ("text/html", "application/xhtml+xml", "text/plain", "application/pdf")
REDIRECTS = (301, 302, 303, 307, 308)
EPOCH_FROM, QUOTA_RESET = 1_000_000_000, 86_400
SERVER_TRIES, FIRST_WAIT, LONGEST_WAIT, NETWORK_WAIT = 3, 0.25, 1.0, 0.25


class Refused(Exception):
    """A rule, or the other side, said no; ``code`` says which."""

    def __init__(self, code: str, status: int | None = None, wait: float | None = None):
        super().__init__(code)
        self.code, self.status, self.wait = code, status, wait


@dataclass(frozen=True)
class Reply:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)
    url: str | None = None

    def header(self, name: str) -> str:
        """A header's value, whatever the case of its name, without characters that headers of this kind don't have."""
        value = next((v for k, v in self.headers.items() if k.lower() == name.lower()), "")
        return re.sub(r"[^A-Za-z0-9,;:=._/ +-]", "", value or "").strip()


# --- rate limits ---


def windows(text: str) -> list[float]:
    """The numbers of a comma list, one for each window, what follows a semicolon left out."""
    out = []
    for part in text.split(","):
        try:
            out.append(float(part.split(";")[0]))
        except ValueError:
            pass
    return out


def resets(reply: Reply, now: float) -> list[float]:
    """Seconds until each window starts anew; large numbers are points in time."""
    return [max(0.0, x - now if x > EPOCH_FROM else x) for x in windows(reply.header("X-RateLimit-Reset"))]


def asked_to_wait(reply: Reply, now: float) -> float | None:
    """Retry-After as seconds, from a number or a date."""
    text = reply.header("Retry-After")
    try:
        return max(0.0, float(text))
    except ValueError:
        pass
    try:
        at = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    return max(0.0, (at if at.tzinfo else at.replace(tzinfo=datetime.UTC)).timestamp() - now)


def quota_used_up(reply: Reply, now: float) -> bool:
    """Whether a window of a day or more is empty; of several windows the last is the long one."""
    left, until = windows(reply.header("X-RateLimit-Remaining")), resets(reply, now)
    if len(left) == 1:
        return left[0] <= 0 and max(until, default=0) >= QUOTA_RESET
    return bool(left) and (left[-1] <= 0 or any(n <= 0 and s >= QUOTA_RESET for n, s in zip(left, until, strict=False)))


# --- search ---


@dataclass
class Patience:
    """What a search may still do about failures: one wait for a burst, one after a network failure, and growing waits for a server's."""

    tries: int = 0
    burst: bool = True
    network: bool = True

    def after(self, reply: Reply | None, left: float, now: float) -> float:
        """Seconds to wait before the next try; ``Refused`` if there is none. ``reply`` is None after a network failure."""
        if reply is None:
            if self.network and NETWORK_WAIT < left:
                self.network = False
                return NETWORK_WAIT
            raise Refused("network")
        code, wait = reply.status, asked_to_wait(reply, now)
        if code in (401, 403):
            raise Refused("authentication", code)
        if code == 402:
            raise Refused("quota_exhausted", code, wait)
        if code == 429:
            if quota_used_up(reply, now):
                raise Refused("quota_exhausted", code, wait)
            wait = min(resets(reply, now), default=None) if wait is None else wait
            if self.burst and wait is not None and wait < left:
                self.burst = False
                return wait
            raise Refused("rate_limit", code, wait)
        grown = min(FIRST_WAIT * 2 ** (self.tries - 1), LONGEST_WAIT)
        if code >= 500 and self.tries < SERVER_TRIES and grown < left:
            return grown
        raise Refused("provider_failure", code, wait)


def ask(url: str, transport: Callable[[str, float], Reply], seconds: float, *, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time) -> tuple[dict, int]:
    """The JSON object that a search returns, and the number of tries, all within ``seconds``."""
    end, patience = clock() + seconds, Patience()
    while True:
        left = end - clock()
        if left <= 0:
            raise Refused("timeout")
        patience.tries += 1
        try:
            reply = transport(url, left)
        except TimeoutError:
            raise Refused("timeout") from None
        except OSError:
            reply = None
        if reply is not None and 200 <= reply.status < 300:
            break
        if pause := patience.after(reply, end - clock(), now()):
            sleep(pause)
    try:
        if len(reply.body) > MAX_SEARCH_BYTES:
            raise ValueError
        found = json.loads(reply.body.decode())
        if not isinstance(found, dict):
            raise ValueError
    except ValueError:
        raise Refused("invalid_response", reply.status) from None
    return found, patience.tries


def hits(payload: dict) -> list[dict]:
    """title, url, snippet, published of each web result of a search's answer; what isn't one is left out."""
    web = payload.get("web")
    results = web.get("results", []) if isinstance(web, dict) else []
    if not isinstance(results, list):
        raise Refused("invalid_response")
    tidy = lambda x: " ".join(str(x or "").split())
    date = lambda r: next((str(r[k]) for k in ("age", "page_age", "published", "date") if r.get(k)), None)
    return [{"title": tidy(r.get("title")), "url": str(r.get("url") or "").strip(), "snippet": tidy(r.get("description")), "published": date(r)} for r in results if isinstance(r, dict)]


# --- fetch ---


def need_public(url: str, resolve: Callable[[str, int], list[str]]) -> None:
    """Every address of the host must be a public one."""
    parts = urlsplit(url)
    if parts.scheme.lower() != "https" or not parts.hostname:
        raise Refused("unsafe_url")
    try:
        found = resolve(parts.hostname, parts.port or 443)
        public = [ipaddress.ip_address(a.split("%")[0]).is_global for a in found]
    except (OSError, ValueError):
        raise Refused("dns_failure") from None
    if not public:
        raise Refused("dns_failure")
    if not all(public):
        raise Refused("unsafe_address")


def follow(
    url: str, transport: Callable[[str, float], Reply], permitted: Callable[[str], str | None], resolve: Callable[[str, int], list[str]], seconds: float,
    *, max_bytes: int = MAX_BYTES, max_redirects: int = MAX_REDIRECTS, types: tuple[str, ...] = CONTENT_TYPES, clock: Callable[[], float] = time.monotonic,
) -> tuple[str, str, Reply]:
    """(final URL, content type, reply). ``permitted`` gives the canonical form of a URL that may be fetched, else None; each hop, and the address that the reply came from, has to pass it and be public."""
    end = clock() + seconds

    def passed(raw: str) -> str:
        if (target := permitted(raw)) is None:
            raise Refused("policy_rejected")
        need_public(target, resolve)
        if clock() >= end:
            raise Refused("timeout")
        return target

    for _ in range(max_redirects + 1):
        at = passed(url)
        try:
            reply = transport(at, end - clock())
        except TimeoutError:
            raise Refused("timeout") from None
        except OSError:
            raise Refused("network_error") from None
        if reply.status not in REDIRECTS:
            break
        if not (location := next((v for k, v in reply.headers.items() if k.lower() == "location"), "")):
            raise Refused("invalid_redirect", reply.status)
        url = urljoin(at, location)
    else:
        raise Refused("redirect_limit")
    if not 200 <= reply.status < 300:
        raise Refused("http_error", reply.status)
    final, kind = passed(reply.url or at), reply.header("Content-Type").split(";")[0].strip().lower()
    if kind not in types:
        raise Refused("unsupported_content_type", reply.status)
    said = reply.header("Content-Length")
    if said and not said.isdigit():
        raise Refused("invalid_response", reply.status)
    if max(int(said or 0), len(reply.body)) > max_bytes:
        raise Refused("oversized", reply.status)
    return final, kind, reply


FETCHED = "url string, status string, http_status int, final_url string, mime string, body binary"


def fetch_all(urls: DataFrame, connect: Callable[[], tuple[Callable, Callable, Callable]], seconds: float = 30.0, **options) -> DataFrame:
    """``follow`` for a column ``url``; failures are rows with a status, not errors. ``connect`` is called once a task and returns transport, permitted and resolve."""

    def run(batches):
        transport, permitted, resolve = connect()
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    final, kind, reply = follow(url or "", transport, permitted, resolve, seconds, **options)
                    rows.append((url, "ok", reply.status, final, kind, reply.body))
                except Refused as e:
                    rows.append((url, e.code, e.status, None, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.split(", ")]).astype({"http_status": "Int32"})

    return urls.select("url").mapInPandas(run, FETCHED)
