"""Every query of the core by name, with its SQL twin where one exists."""

from __future__ import annotations

from veilspan.plans import analytics, detection, language, models, monitoring, problems, service, texts

MODULES = (detection, analytics, monitoring, texts, language, models, problems, service)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
