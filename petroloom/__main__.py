import sys

from petroloom.cli import main

sys.exit(main())
