"""Who may write and who may read: API keys, and HS256 tokens that name a tenant."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from datetime import UTC, datetime

from tidewell.requests import RequestError, TenantScope

MIN_KEY_BYTES = 32
SKEW_SECONDS = 30


class ApiKeys:
    """Exact match; without keys nobody may write."""

    def __init__(self, keys: list[str]):
        self._keys = frozenset(k for k in keys if k)

    def allows(self, header: str | None = None, query: str | None = None) -> bool:
        """The header wins over the query string."""
        return (header or query or "") in self._keys


class Tokens:
    def __init__(self, key: str, project_claim: str = "project_id", tenant_claim: str = "tenant_id"):
        self._key, self._claims = key.encode(), (project_claim, tenant_claim)
        if len(self._key) < MIN_KEY_BYTES:
            raise ValueError(f"the key needs {MIN_KEY_BYTES} bytes")

    def scope(self, token: str, now: datetime) -> TenantScope:
        """The tenant that a valid token names. RequestError 401 if it isn't valid, 403 if it names none."""
        try:
            signed, _, signature = token.rpartition(".")
            head, body = (json.loads(_bytes(p)) for p in signed.split("."))
            fine = head.get("alg") == "HS256" and hmac.compare_digest(hmac.new(self._key, signed.encode(), hashlib.sha256).digest(), _bytes(signature))
            at = now.replace(tzinfo=UTC).timestamp() if now.tzinfo is None else now.timestamp()
            fine = fine and float(body["exp"]) + SKEW_SECONDS > at >= float(body.get("nbf", 0)) - SKEW_SECONDS
        except (ValueError, KeyError, TypeError, AttributeError):
            fine = False
        if not fine:
            raise RequestError(401)
        project, tenant = (body.get(c) for c in self._claims)
        if not all(isinstance(x, str) and x.strip() for x in (project, tenant)):
            raise RequestError(403)
        return TenantScope(project, tenant)


def _bytes(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
