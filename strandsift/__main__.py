import sys

from strandsift.cli import main

sys.exit(main())
