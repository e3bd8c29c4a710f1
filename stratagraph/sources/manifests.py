"""Project manifests as records: module, versions, dependencies and features."""

from __future__ import annotations

import configparser
import json
import re
import tomllib

FIELDS = ("kind", "name", "module", "go_version", "requires_python", "edition")
LISTS = ("package_roots", "local_deps", "external_deps", "features", "workspace_members", "workspace_exclude")


def _record(kind: str, **values: object) -> dict:
    record = {"kind": kind}
    for name in FIELDS[1:]:
        if (value := str(values.get(name) or "").strip()):
            record[name] = value
    for name in LISTS:
        if (items := sorted({str(v).strip().replace("\\", "/") for v in values.get(name) or [] if str(v).strip()})):
            record[name] = items
    return record


def encode(record: dict) -> str:
    """JSON without empty fields, lists sorted; '' for an empty record."""
    kept = _record(record.get("kind", ""), **{k: v for k, v in record.items() if k != "kind"})
    return json.dumps(kept, separators=(",", ":"), ensure_ascii=False) if any(kept.values()) else ""


def decode(value: str | None) -> dict:
    try:
        found = json.loads(value) if value and value.strip() else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def go_mod(text: str) -> dict:
    text = re.sub(r"//[^\n]*", "", text)
    blocks = {word: [] for word in ("require", "replace")}
    for word in blocks:
        for body in re.findall(rf"^{word}\s*\((.*?)\)", text, re.M | re.S):
            blocks[word] += body.splitlines()
        blocks[word] += re.findall(rf"^{word}\s+([^(\n]+)$", text, re.M)
    module, version = re.search(r"^module\s+(\S+)", text, re.M), re.search(r"^go\s+(\S+)", text, re.M)
    requires = [line.split()[0] for line in blocks["require"] if line.split()]
    local = []
    for line in blocks["replace"]:
        old, arrow, new = line.partition("=>")
        if arrow and old.split() and new.split() and new.split()[0].startswith((".", "/")):
            local.append(f"{old.split()[0]}=>{new.split()[0]}")
    return _record("go.mod", module=module and module[1].strip('"'), go_version=version and version[1], external_deps=requires, local_deps=local)


def python_requirement(value: str) -> tuple[str, bool]:
    """(label, local?) of one dependency entry."""
    value = value.split(" #")[0].strip()
    if value.startswith(("-e ", "--editable ")):
        value = value.split(None, 1)[1]
    if value.startswith((".", "/", "file:")):
        return value, True
    name, at, target = value.partition("@")
    if at and target.strip().startswith(("file:", ".", "/")):
        return value.replace(" ", ""), True
    return re.split(r"[\s\[<>=!~;@]", value, maxsplit=1)[0].lower(), False


def _split(values: list[str]) -> dict:
    parsed = [python_requirement(v) for v in values if v.strip()]
    return {"local_deps": [v for v, local in parsed if local], "external_deps": [v for v, local in parsed if not local]}


def pyproject(text: str) -> dict:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {"kind": "pyproject.toml"}
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    deps = [*project.get("dependencies", []), *(d for group in project.get("optional-dependencies", {}).values() for d in group), *(k for k in poetry.get("dependencies", {}) if k != "python")]
    find = data.get("tool", {}).get("setuptools", {}).get("packages", {})
    roots = find.get("find", {}).get("where", []) if isinstance(find, dict) else []
    return _record("pyproject.toml", name=project.get("name") or poetry.get("name"), requires_python=project.get("requires-python") or poetry.get("dependencies", {}).get("python"), package_roots=roots, features=list(project.get("optional-dependencies", {})), **_split(deps))


def cargo(text: str) -> dict:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {"kind": "Cargo.toml"}
    package, space = data.get("package", {}), data.get("workspace", {})
    local, external = [], []
    for table in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, spec in data.get(table, {}).items():
            (local if isinstance(spec, dict) and "path" in spec else external).append(f"{name}=>{spec['path']}" if isinstance(spec, dict) and "path" in spec else name)
    return _record("Cargo.toml", name=package.get("name"), edition=package.get("edition"), local_deps=local, external_deps=external, features=list(data.get("features", {})), workspace_members=space.get("members"), workspace_exclude=space.get("exclude"))


def setup_cfg(text: str) -> dict:
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    try:
        parser.read_string(text)
    except configparser.Error:
        return {"kind": "setup.cfg"}
    get = lambda s, o: parser.get(s, o, fallback="")
    return _record("setup.cfg", name=get("metadata", "name"), requires_python=get("options", "python_requires"), package_roots=get("options.packages.find", "where").split(), **_split(get("options", "install_requires").splitlines()))


def setup_py(text: str) -> dict:
    name, python = (re.search(rf"\b{k}\s*=\s*[\"']([^\"']+)", text) for k in ("name", "python_requires"))
    block = re.search(r"install_requires\s*=\s*\[(.*?)\]", text, re.S)
    deps = re.findall(r"[\"']([^\"']+)[\"']", block[1]) if block else []
    return _record("setup.py", name=name and name[1], requires_python=python and python[1], **_split(deps))


def requirements(text: str) -> dict:
    lines = [x.strip() for x in text.splitlines()]
    return _record("requirements.txt", **_split([x for x in lines if x and not x.startswith(("#", "-r", "--r", "-c", "--c", "--i", "-i", "--f", "-f"))]))


def pipfile(text: str) -> dict:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {"kind": "Pipfile"}
    local, external = [], []
    for table in ("packages", "dev-packages"):
        for name, spec in data.get(table, {}).items():
            here = isinstance(spec, dict) and "path" in spec
            (local if here else external).append(f"{name}=>{spec['path']}" if here else name.lower())
    return _record("Pipfile", requires_python=data.get("requires", {}).get("python_version"), local_deps=local, external_deps=external)


PARSERS = {"go.mod": go_mod, "pyproject.toml": pyproject, "Cargo.toml": cargo, "setup.cfg": setup_cfg, "setup.py": setup_py, "requirements.txt": requirements, "Pipfile": pipfile}


def parse(path: str, text: str) -> dict:
    """The record of a manifest by its base name; {} for other files."""
    parser = PARSERS.get(path.replace("\\", "/").rsplit("/", 1)[-1])
    return parser(text) if parser else {}


def list_delta(before: list[str], after: list[str]) -> tuple[list[str], list[str]]:
    return [x for x in after if x not in set(before)], [x for x in before if x not in set(after)]
