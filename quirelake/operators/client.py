"""A client of chat endpoints that follow the usual HTTP interface, through whichever SDK is installed."""

from __future__ import annotations

import base64
import importlib
import mimetypes
from collections.abc import Sequence

from quirelake.sources.config import Endpoint

TRANSCRIBE = """Write down all text of this scanned page, exactly as it is printed.
Give the text alone, in reading order and with its line breaks and hyphens.
Don't complete, correct, rephrase or translate anything.
Leave out what can't be read; no line and no filler word may be repeated."""

CLEANUP = """The text of the user was recognised on the page of a scanned book. It is the authority.
Turn it into a fragment of XHTML and give nothing but that fragment, without html or body elements.
Don't add any word, fact or sentence; keep the wording, and mend only what is beyond doubt a misreading.
Join broken lines into paragraphs and leave out running headers, footers and page numbers.
Keep headings, italics, lists, tables and footnotes."""
#: Part of every cache key of rewrites; to be raised with each change of CLEANUP.
CLEANUP_VERSION = "1"


class Chat:
    """Made where it is used: the SDK is imported with the first call."""

    def __init__(self, endpoint: Endpoint) -> None:
        self.endpoint, self._sdk = endpoint, None

    @property
    def sdk(self) -> object:
        if self._sdk is None:
            self._sdk = importlib.import_module("openai").OpenAI(base_url=self.endpoint.url, api_key=self.endpoint.key or "none")
        return self._sdk

    def models(self) -> list[str]:
        return [x.id for x in self.sdk.models.list().data]

    def say(self, model: str, messages: Sequence[dict], temperature: float = 0.0, **limits: float | None) -> str:
        """The answer to messages; limits (max_tokens, frequency_penalty, presence_penalty) that are None aren't sent."""
        given = {k: v for k, v in limits.items() if v is not None}
        answer = self.sdk.chat.completions.create(model=model, messages=list(messages), temperature=temperature, **given)
        return answer.choices[0].message.content or ""

    def vision(self, model: str, image: bytes, prompt: str, name: str = "page.png", temperature: float = 0.0, max_tokens: int | None = 2048, **limits: float | None) -> str:
        kind = mimetypes.guess_type(name)[0] or "image/png"
        url = f"data:{kind};base64,{base64.b64encode(image).decode()}"
        parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": url}}]
        return self.say(model, [{"role": "user", "content": parts}], temperature, max_tokens=max_tokens, **limits)

    def cleanup(self, model: str, page_text: str) -> str:
        return self.say(model, [{"role": "system", "content": CLEANUP}, {"role": "user", "content": page_text}])
