"""Places of a session's files, and catalogues of sessions (driver side)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from ..functions.text import SESSION_NAME

#: Extensions of a session's files, by whether there is one for each shank.
WHOLE = {"yaml": "yaml", "dat": "dat", "lfp": "lfp", "evt": "all.evt", "ses": "ses.parquet", "stc": "stc.parquet", "pos": "pos.parquet"}
SHANK = {"res": "res", "clu": "clu", "spk": "spk", "fet": "fet", "pca": "pca", "clc": "clc", "clp": "clp", "col": "col"}


@dataclass(frozen=True)
class SessionPaths:
    """Folders and files of a session `source-user-subject-date` under a root."""

    name: str
    root: str = "/data"
    project: str = ""
    maze: str = "all"
    parts: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        found = re.match(SESSION_NAME, self.name)
        if not found:
            raise ValueError(f"not a session name: {self.name!r}")
        object.__setattr__(self, "parts", found.groups())

    @property
    def subject(self) -> str:
        """The subject, digits padded to six."""
        subject = self.parts[2]
        return subject.zfill(6) if subject.isdigit() else subject

    def folder(self, kind: str) -> str:
        """processed/ephys, processed/mocap, source/ephys, source/mocap or source/video."""
        stage, what = kind.split("/")
        source, user, _, _ = self.parts
        return str(PurePosixPath(self.root, stage, what, source, user, f"{source}-{user}-{self.subject}", self.name))

    def file(self, kind: str, shank: int | None = None, method: str = "standard") -> str:
        """A file by kind (a name of WHOLE or SHANK)."""
        base = PurePosixPath(self.folder("processed/ephys"), self.name)
        if kind in WHOLE:
            return f"{base}.{WHOLE[kind]}"
        if shank is None:
            raise ValueError(f"{kind} files have a shank")
        return f"{base}.{SHANK[kind]}.{shank}" if method == "standard" else f"{base}.{SHANK[kind]}.{method}.{shank}"


def load_catalogue(text: str) -> list[dict]:
    """Records of a JSON catalogue {subjects, lists}: each session's values over those of its subject, with list and position."""
    doc = json.loads(text)
    out = []
    for name, sessions in doc.get("lists", {}).items():
        for i, session in enumerate(sessions):
            subject = doc.get("subjects", {}).get(session.get("subject"), {})
            record = {**subject, **{k: v for k, v in session.items() if v is not None}}
            out.append({"list": name, "position": i, **record})
    return out
