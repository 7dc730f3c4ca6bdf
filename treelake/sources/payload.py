"""Tolerant reading of page-tree JSON as it is delivered: marks, log lines, wrappers."""

from __future__ import annotations

import json

WRAPPERS = ("som", "data", "result")
_DECODER = json.JSONDecoder()


def as_object(value: object) -> object:
    """A JSON value that may also be written as JSON text; text that isn't JSON becomes None."""
    if isinstance(value, str):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def as_list(value: object) -> list:
    """A collection written as a list, a single object, a keyed object of objects, JSON text or nothing."""
    value = as_object(value) if isinstance(value, str) and value.lstrip()[:1] in ("[", "{") else value
    if value is None:
        return []
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and value and "id" not in value and "role" not in value and all(isinstance(x, dict) for x in value.values()):
        return list(value.values())
    return [value]


def _unwrap(value: object) -> dict | None:
    for _ in range(4):
        value = as_object(value)
        if not isinstance(value, dict):
            return None
        if "regions" in value:
            return value
        inner = next((value[w] for w in WRAPPERS if value.get(w) is not None), None)
        if inner is None:
            return None
        value = inner
    return None


def read_tree(payload: str | None) -> dict | None:
    """The page tree of a payload; the last whole one if there are several; None if there is none.

    A byte-order mark and text before, between and after objects are skipped. An object that the
    text ends inside of is a torn payload: nothing is read out of its inside.
    """
    if not payload:
        return None
    found, at, text = None, 0, payload.lstrip("﻿ \t\r\n")
    if text[:1] == '"':
        try:
            return _unwrap(json.loads(text))
        except (ValueError, RecursionError):
            return None
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = _DECODER.raw_decode(text, at)
        except RecursionError:
            return found
        except json.JSONDecodeError as e:
            head = text[at + 1 : at + 64].lstrip()
            if head[:1] in ('"', "}", "") or e.pos >= len(text) - 1:
                return None if head[:1] == '"' else found
            at += 1
            continue
        found = _unwrap(value) or found
    return found
