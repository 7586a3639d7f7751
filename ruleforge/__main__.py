"""python -m ruleforge: see scan."""

from ruleforge.scan import main

raise SystemExit(main())
