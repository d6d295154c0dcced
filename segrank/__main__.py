"""python -m segrank run | audit | sweep | zero-history"""

import sys

from segrank.plans.run import main

sys.exit(main())
