"""A model behind HTTP, as a factory that executors call: one kept connection a worker, time limits, retries."""

from __future__ import annotations

import http.client
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from fathomline.sources.models import retried


class Connection:
    """One connection to a host, opened anew after an error."""

    def __init__(self, host: str, timeout: float):
        url = urlsplit(host)
        kind = http.client.HTTPSConnection if url.scheme == "https" else http.client.HTTPConnection
        self.base, self.timeout = url.path.rstrip("/"), timeout
        self.http = kind(url.hostname or "localhost", url.port, timeout=timeout)

    def ask(self, path: str, payload: dict | None = None, timeout: float | None = None) -> dict:
        """The JSON answer; another status than 2xx is an error."""
        self.http.timeout = timeout or self.timeout
        if self.http.sock is not None:
            self.http.sock.settimeout(self.http.timeout)
        try:
            body = None if payload is None else json.dumps(payload)
            self.http.request("GET" if body is None else "POST", self.base + path, body, {"Content-Type": "application/json"})
            answer = self.http.getresponse()
            text = answer.read()
        except (OSError, http.client.HTTPException):
            self.http.close()
            raise
        if not 200 <= answer.status < 300:
            raise OSError(f"{path}: status {answer.status}")
        return json.loads(text)


@dataclass(frozen=True)
class Endpoint:
    """A generator at host; calling it makes the model in a worker: texts in, answers out.

    options are sent with each prompt; form is a JSON schema, or "json", that answers must
    fit. A failed prompt is sent again up to `retries` times, after 1, 2, 4, then 8 seconds;
    then its error ends the task.
    """

    host: str
    model: str
    system: str | None = None
    options: dict = field(default_factory=lambda: {"temperature": 0.2, "top_p": 0.9, "num_ctx": 8192, "num_predict": 1024})
    form: dict | str | None = None
    timeout: float = 300.0
    retries: int = 2
    pause: Callable[[float], None] | None = None

    def payload(self, prompt: str) -> dict:
        more = {"system": self.system, "format": self.form}
        return {"model": self.model, "prompt": prompt, "stream": False, "options": self.options} | {k: v for k, v in more.items() if v is not None}

    def __call__(self) -> Callable[[Sequence[str]], list[str]]:
        connection = Connection(self.host, self.timeout)
        waits = {} if self.pause is None else {"pause": self.pause}

        def model(prompts: Sequence[str]) -> list[str]:
            ask = lambda p: retried(lambda: connection.ask("/api/generate", self.payload(p)), self.retries, **waits)
            return [ask(p).get("response", "") for p in prompts]

        return model

    def models(self) -> list[str]:
        """Names of the models that the host has; none if it does not answer."""
        try:
            return [m.get("name", "") for m in Connection(self.host, 10).ask("/api/tags").get("models", [])]
        except (OSError, http.client.HTTPException, ValueError):
            return []

    def ping(self) -> bool:
        """Whether the host answers within five seconds."""
        try:
            Connection(self.host, 5).ask("/api/tags")
        except (OSError, http.client.HTTPException, ValueError):
            return False
        return True
