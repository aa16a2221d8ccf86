"""All document queries: importing the operator modules registers them."""

from __future__ import annotations

import importlib

MODULES = ["find", "placement", "nested", "patches", "synth", "script", "objects", "caret", "layout", "grid", "profile", "style", "spatial", "selection", "edit", "ops", "context", "intents", "fill", "charts", "files", "glyphs", "markup", "runs", "headers", "geometry", "extensions"]

for _name in MODULES:
    importlib.import_module(f"quire.operators.{_name}")
importlib.import_module("quire.streaming.sessions")
