import sys

from rulespan.cli import main

sys.exit(main())
