"""Clients of language models that run beside the engine (A17 to A19). Opt-in: nothing calls them unless one is passed to operators.analyst.ask()."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.error import HTTPError
from urllib.parse import urljoin
from urllib.request import Request, urlopen

SYSTEM = "You review evidence for mapping an unknown function to a known one. Use only the evidence given. Answer with one JSON object."


class Refused(RuntimeError):
    """A server's answer with an HTTP status of an error: `status`, and `body`, its words."""

    def __init__(self, status: int, body: str) -> None:
        super().__init__(f"HTTP {status}: {body}")
        self.status, self.body = status, body


@dataclass(frozen=True)
class Server:
    """Where a model server is, how long an answer may take, and what every request carries."""

    url: str
    timeout: float = 120.0
    headers: dict[str, str] = field(default_factory=dict)

    def post(self, path: str, body: dict) -> dict:
        """The JSON answer to a JSON body, posted to a path below the server's URL."""
        asked = Request(urljoin(self.url if self.url.endswith("/") else self.url + "/", path), method="POST")
        for name, value in {"Content-Type": "application/json", **self.headers}.items():
            asked.add_header(name, value)
        asked.data = json.dumps(body, ensure_ascii=False).encode()
        try:
            with urlopen(asked, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except HTTPError as refusal:
            with refusal:
                words = refusal.read().decode("utf-8", "replace")
            raise Refused(refusal.code, words) from None


# The ports at which such servers listen unless told otherwise, and their paths.
OLLAMA_URL, OLLAMA_PATH = "http://localhost:11434", "api/generate"
CHAT_URL, CHAT_PATH = "http://localhost:1234/v1", "chat/completions"
#: The variable that holds a key where a server asks for one.
KEY_VARIABLE = "OPENAI_API_KEY"


def ollama(model: str, base_url: str | None = None, timeout: float = 120.0, temperature: float = 0.1) -> Callable[[str], str]:
    """Whole answers in JSON."""
    server = Server(base_url or OLLAMA_URL, timeout)
    fixed = {"model": model, "stream": False, "format": "json", "options": {"temperature": temperature}}
    return lambda prompt: server.post(OLLAMA_PATH, {**fixed, "prompt": "\n\n".join((SYSTEM, prompt))}).get("response", "")


def chat_completions(model: str, base_url: str | None = None, temperature: float = 0.1, timeout: float = 120.0, json_only: bool = False) -> Callable[[str], str]:
    """Servers with a chat completions interface. A key is sent only where KEY_VARIABLE holds one when the client is made."""
    key = os.environ.get(KEY_VARIABLE)
    server = Server(base_url or CHAT_URL, timeout, {"Authorization": f"Bearer {key}"} if key else {})
    wanted = {"response_format": {"type": "json_object"}} if json_only else {}

    def ask(prompt: str) -> str:
        turns = [{"role": role, "content": text} for role, text in (("system", SYSTEM), ("user", prompt))]
        answer = server.post(CHAT_PATH, {"model": model, "temperature": temperature, "messages": turns, **wanted})
        return answer["choices"][0]["message"]["content"]

    return ask
