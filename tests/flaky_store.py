"""A store that counts its calls and fails as it is told, for the serving tests."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from riskspark.sinks.serving import FolderStore


class FlakyStore(FolderStore):
    """Fails the first ``failures`` calls for batches that hold the entity ``victim``, half of it stored."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.calls = Path(options["calls"])
        self.victim, self.failures = int(options["victim"]), int(options["failures"])

    def send(self, batch: list[dict]) -> None:
        self.calls.mkdir(parents=True, exist_ok=True)
        ids = [r["entity_id"] for r in batch]
        if self.victim in ids and len(list(self.calls.glob("failed-*"))) < self.failures:
            (self.calls / f"failed-{uuid.uuid4().hex}").write_text("")
            super().send(batch[: len(batch) // 2])
            raise OSError("store is away")
        (self.calls / f"sent-{uuid.uuid4().hex}").write_text(json.dumps(ids))
        super().send(batch)
