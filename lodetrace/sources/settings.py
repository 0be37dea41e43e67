"""A project's policy file."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fields of a policy and their types.
FIELDS = {"max_cvss_severity": (int, float), "block_on_kev": bool, "min_maintainers": int, "block_on_secrets": bool, "license_denylist": list}


class PolicyError(ValueError):
    code = "POLICY"


@dataclass
class Policy:
    values: dict = field(default_factory=dict)


def read_policy(text: str | None) -> Policy:
    """An absent file is an empty policy; a malformed one, or a field of another type, an error."""
    import yaml

    if not text or not text.strip():
        return Policy()
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise PolicyError(str(e)) from e
    if doc is None:
        return Policy()
    if not isinstance(doc, dict):
        raise PolicyError("a policy is a mapping")
    for k, v in doc.items():
        if k in FIELDS and (not isinstance(v, FIELDS[k]) or isinstance(v, bool) and FIELDS[k] is not bool):
            raise PolicyError(f"{k} has another type")
    return Policy({k: v for k, v in doc.items() if k in FIELDS})
