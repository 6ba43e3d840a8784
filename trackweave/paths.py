"""Names of caches and folders."""

from __future__ import annotations


def cache_path(model: str, sparse: bool, cache: str | None = None, output: str | None = None) -> str | None:
    """Where a model's features are cached: `cache` itself if it names a table, a table named by model and density in it or else in `output`; None without either."""
    folder = cache if cache is not None else output
    if folder is None or folder.endswith(".parquet"):
        return folder
    return f"{folder.rstrip('/')}/{model}_featuremaps_{'sparse' if sparse else 'dense'}.parquet"


def filled(template: str, **values: object) -> str:
    """The template with each {name} that is given replaced; others stay, to be filled later."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    return template
