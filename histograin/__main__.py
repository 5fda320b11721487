"""``python -m histograin``."""

from .cli import main

raise SystemExit(main())
