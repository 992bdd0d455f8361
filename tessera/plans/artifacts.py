"""Files around a run, on the driver: exports with a manifest, outputs that may be replaced, safe archive members."""

from __future__ import annotations

import json
import shutil
import zipfile
from pathlib import Path, PurePosixPath

from tessera.plans.model import file_sha256

#: Marks a folder as one that runs may replace.
OWNED = ".tessera-owned"


def export(files: dict[str, str], folder: str) -> dict:
    """Copies files by name into a folder and writes a manifest of sizes and digests beside them."""
    missing = [p for p in files.values() if not Path(p).is_file()]
    if missing:
        raise FileNotFoundError(f"missing artifacts: {missing}")
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    said = {}
    for name, path in sorted(files.items()):
        shutil.copyfile(path, out / name)
        said[name] = {"bytes": Path(path).stat().st_size, "sha256": file_sha256(path)}
    (out / "manifest.json").write_text(json.dumps(said, indent=2, sort_keys=True) + "\n")
    return said


def own(folder: str, replace: bool = False) -> Path:
    """An empty folder for a run's outputs. One that exists is replaced only if asked and only if a run made it."""
    out = Path(folder).resolve()
    if out.exists() and any(out.iterdir()):
        if not replace:
            raise FileExistsError(f"{out} exists")
        if not (out / OWNED).is_file() or out in (Path.home().resolve(), Path(out.anchor), Path.cwd()):
            raise PermissionError(f"{out} isn't a folder that a run made")
        shutil.rmtree(out)
    out.mkdir(parents=True, exist_ok=True)
    (out / OWNED).touch()
    return out


def extract(archive: str, folder: str, sha256: str | None = None) -> dict:
    """Unpacks a zip archive into a folder that must not hold anything yet, and says what is there. A wrong digest, a broken member or one that would leave the folder fails before anything is written."""
    found = file_sha256(archive)
    if sha256 is not None and found != sha256.lower():
        raise ValueError(f"{archive} has the digest {found}, not {sha256}")
    out = Path(folder)
    if out.exists() and any(out.iterdir()):
        raise FileExistsError(f"{out} exists")
    with zipfile.ZipFile(archive) as z:
        names = [i.filename for i in z.infolist()]
        unsafe = [n for n in names if not safe_member(n)] + [i.filename for i in z.infolist() if (i.external_attr >> 16) & 0o170000 == 0o120000]
        if unsafe:
            raise ValueError(f"unsafe members: {unsafe[:5]}")
        if broken := z.testzip():
            raise ValueError(f"broken member: {broken}")
        z.extractall(out)
    return {"archive": Path(archive).name, "sha256": found, "members": sorted(n for n in names if not n.endswith("/"))}


def safe_member(name: str) -> bool:
    """Whether an archive's member stays within the folder it is extracted to."""
    path = PurePosixPath(name.replace("\\", "/"))
    return not path.is_absolute() and ".." not in path.parts and not name[1:2] == ":"
