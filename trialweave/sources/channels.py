"""Notification channels: a signal as each service's message.  Sending is the caller's ``post(url, body)``."""

from __future__ import annotations

from collections.abc import Callable

# The field that each service takes its text from.
TEXT_FIELDS = {"webhook": "text", "mattermost": "text", "slack": "text", "teams": "text", "googlechat": "text", "discord": "content", "telegram": "text", "ntfy": "message", "email": "body"}


def message(kind: str, signal: dict, **options) -> dict:
    """``signal`` (``title``, ``text``, ...) as the body of a channel of this kind; options (chat, topic, to) are added."""
    if kind not in TEXT_FIELDS:
        raise ValueError(f"no channel {kind!r}")
    lines = [signal.get("title", ""), signal.get("text", "")]
    body = {TEXT_FIELDS[kind]: "\n".join(x for x in lines if x)} | options
    if kind == "webhook":
        body["signal"] = signal
    if kind == "email":
        body.setdefault("subject", signal.get("title", ""))
    return body


def send(channels: list[dict], signals: list[dict], post: Callable[[str, dict], None]) -> list[tuple[str, str]]:
    """Every signal to every channel whose ``kinds`` allow it; one channel's failure, returned with its error, stops no other."""
    failed = []
    for channel in channels:
        for signal in signals:
            if channel.get("kinds") is not None and signal.get("kind") not in channel["kinds"]:
                continue
            try:
                post(channel["url"], message(channel["type"], signal, **channel.get("options", {})))
            except Exception as e:  # noqa: BLE001
                failed.append((channel["type"], str(e)))
    return failed
