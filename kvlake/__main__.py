import sys

from kvlake.cli import main

sys.exit(main())
