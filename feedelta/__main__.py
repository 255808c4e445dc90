import sys

from feedelta.cli import main

sys.exit(main())
