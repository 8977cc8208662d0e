"""Models as JSON files: <root>/<database>/<collection>.json, with a small cache on the driver. A model is small; its size doesn't depend on the data."""

from __future__ import annotations

import json
from collections import OrderedDict
from pathlib import Path

CACHED = 100


class ModelStore:
    def __init__(self, root: str):
        self.root = Path(root)
        self.cache: OrderedDict[tuple[str, str], dict] = OrderedDict()

    def _path(self, database: str, collection: str) -> Path:
        for name in (database, collection):
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"not a name: {name!r}")
        return self.root / database / f"{collection}.json"

    def get(self, database: str, collection: str) -> dict | None:
        key = (database, collection)
        if key not in self.cache:
            path = self._path(*key)
            if not path.exists():
                return None
            self.cache[key] = json.loads(path.read_text())
            while len(self.cache) > CACHED:
                self.cache.popitem(last=False)
        self.cache.move_to_end(key)
        return self.cache[key]

    def save(self, database: str, collection: str, model: dict) -> None:
        path = self._path(database, collection)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(model, indent=1, default=str))
        self.cache[(database, collection)] = model

    def delete(self, database: str, collection: str) -> bool:
        self.cache.pop((database, collection), None)
        path = self._path(database, collection)
        existed = path.exists()
        path.unlink(missing_ok=True)
        return existed

    def drop_database(self, database: str) -> int:
        return sum(self.delete(database, name) for name in self.collections(database))

    def databases(self) -> list[str]:
        return sorted(p.name for p in self.root.iterdir() if p.is_dir()) if self.root.exists() else []

    def collections(self, database: str) -> list[str]:
        folder = self.root / database
        return sorted(p.stem for p in folder.glob("*.json")) if folder.exists() else []

    def stats(self, database: str, collection: str) -> dict | None:
        model = self.get(database, collection)
        if model is None:
            return None
        fields = list((model.get("properties") or {}).values())
        file = self._path(database, collection).stat()
        return {"size": file.st_size, "modified": file.st_mtime, "properties": len(fields), "has_histograms": any("histogram" in f for f in fields), "has_string_models": any("stringModel" in f for f in fields), "has_tides": bool(model.get("tidesConfig"))}
