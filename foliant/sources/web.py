"""Fetches over the network: one address at a time, with time limits, redirects that are checked, and a rate limit for the process."""

from __future__ import annotations

import ipaddress
import socket
import ssl
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from ..errors import NetworkError
from ..functions import classify

# Limits of a fetch.
TIMEOUT, MAX_REDIRECTS = 15, 10
AGENT = "foliant/1.0"


def addresses(host: str) -> list[str]:
    """The numbers of a host's addresses."""
    return sorted({x[4][0] for x in socket.getaddrinfo(host, None)})


def is_public(url: str, resolve: Callable[[str], list[str]] = addresses) -> bool:
    """Whether an address is of the web, and none of its host's numbers lies in a blocked network. A host that can't be resolved is not."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.hostname == "localhost":
        return False
    nets = [ipaddress.ip_network(n) for n in classify.BLOCKED_NETWORKS]
    try:
        numbers = [ipaddress.ip_address(x.split("%")[0]) for x in resolve(parts.hostname)]
    except (OSError, ValueError):
        return False
    return bool(numbers) and not any(n in net for n in numbers for net in nets if n.version == net.version)


class _Checked(urllib.request.HTTPRedirectHandler):
    def __init__(self, allowed: Callable[[str], bool], most: int):
        self.allowed, self.max_redirections = allowed, most

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not self.allowed(newurl):
            raise NetworkError(f"redirect to an address that is not allowed: {newurl}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


class Web:
    """Calls it takes: ``get`` as (status, content type, text), ``bytes`` of a file. ``delay``: least seconds between two calls of
    this process. ``allowed`` is asked for every address, redirects too. Can be sent to workers; each has its own clock."""

    def __init__(self, timeout: float = TIMEOUT, delay: float = 0.0, verify: bool = True, agent: str = AGENT, allowed: Callable[[str], bool] = is_public, max_redirects: int = MAX_REDIRECTS):
        self.timeout, self.delay, self.verify, self.agent, self.allowed, self.max_redirects = timeout, delay, verify, agent, allowed, max_redirects

    def headers(self) -> dict[str, str]:
        return {"User-Agent": self.agent, "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.5"}

    def _open(self, url: str):
        if not self.allowed(url):
            raise NetworkError(f"address that is not allowed: {url}")
        _wait(self.delay)
        context = ssl.create_default_context()
        if not self.verify:
            context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
        opener = urllib.request.build_opener(_Checked(self.allowed, self.max_redirects), urllib.request.HTTPSHandler(context=context))
        try:
            return opener.open(urllib.request.Request(url, headers=self.headers()), timeout=self.timeout)
        except urllib.error.HTTPError:
            raise
        except (OSError, ValueError) as e:
            raise NetworkError(f"{url}: {e}") from e

    def get(self, url: str) -> tuple[int, str, str]:
        try:
            with self._open(url) as answer:
                kind, data = answer.headers.get("Content-Type", ""), answer.read()
                return answer.status, kind, data.decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.headers.get("Content-Type", ""), ""
        except (OSError, LookupError) as e:  # while it is read
            raise NetworkError(f"{url}: {e}") from e

    def bytes(self, url: str) -> bytes:
        try:
            with self._open(url) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            raise NetworkError(f"{url}: status {e.code}") from e
        except OSError as e:
            raise NetworkError(f"{url}: {e}") from e


_lock, _next = threading.Lock(), [0.0]


def _wait(delay: float) -> None:
    """Waits for this call's turn: calls of a process, in whatever thread, are ``delay`` seconds apart."""
    if delay <= 0:
        return
    with _lock:
        at = max(_next[0], time.monotonic())
        _next[0] = at + delay
    if (rest := at - time.monotonic()) > 0:
        time.sleep(rest)
