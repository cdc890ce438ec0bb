import sys

from factloom.cli import main

sys.exit(main())
