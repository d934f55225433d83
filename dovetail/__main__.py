import sys

from dovetail.cli import main

sys.exit(main())
